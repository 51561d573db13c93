"""Plain versions of what the text operators compute, for small inputs."""

import collections
import math


def kneser_ney(grams: collections.Counter, points: int = 0x110000):
    """A function (context, last) -> probability: the interpolated modified Kneser-Ney model of counted four-grams (context of three, last)."""
    counts = {4: dict(grams)}
    for k in (3, 2, 1):
        counts[k] = collections.Counter((context[1:], last) for context, last in counts[k + 1])
    total, discounts, kinds = {}, {}, {}
    for k, c in counts.items():
        t = [0] + [max(1, sum(n == j for n in c.values())) for j in (1, 2, 3, 4)]
        y = t[1] / (t[1] + 2 * t[2])
        discounts[k] = [0] + [min(max(j - (j + 1) * y * t[j + 1] / t[j], 0.05), most) for j, most in ((1, 0.95), (2, 1.9), (3, 2.9))]
        total[k], kinds[k] = collections.Counter(), collections.defaultdict(list)
        for (context, _), n in c.items():
            total[k][context] += n
            kinds[k][context].append(min(n, 3))

    def p(context, last):
        k = len(context) + 1
        below = p(context[1:], last) if k > 1 else 1 / points
        if not total[k][context]:
            return below
        n, d = counts[k].get((context, last), 0), discounts[k]
        rest = sum(d[j] for j in kinds[k][context])
        return (n - d[min(n, 3)] + rest * below) / total[k][context]

    return p


def four_grams(text: str):
    padded = "   " + text
    return [(padded[i : i + 3], padded[i + 3]) for i in range(len(text))]


def bits(model, text: str) -> float:
    return -sum(math.log2(model(c, x)) for c, x in four_grams(text)) / len(text)


def splitmix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return x ^ (x >> 31)


def hashed_grams(text: str, dimensions: int) -> collections.Counter:
    """Counts of the 1- to 3-grams of folded letters and single spaces, by hashed dimension."""
    s = ""
    for c in text:
        x = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
        if x != " " or not s.endswith(" "):
            s += x
    out = collections.Counter()
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            code = 0
            for c in s[i : i + n]:
                code = code << 21 | ord(c)
            out[splitmix((code + n) % 2**64) % dimensions] += 1
    return out


def tf_idf(counts: collections.Counter, idf: dict) -> dict:
    v = {k: math.log1p(n) * idf[k] for k, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    return {k: x / norm for k, x in v.items()}


def walk(lines: list[str], x: list[float]) -> float:
    """What a tree, written as indented lines of If (feature k <= t), Else and Predict, gives for x."""
    i = 0
    while not lines[i].strip().startswith("Predict:"):
        line = lines[i].strip()
        depth = len(lines[i]) - len(lines[i].lstrip())
        k, t = line.split("(feature ")[1].rstrip(")").split(" <= ")
        i += 1
        if x[int(k)] > float(t):
            while len(lines[i]) - len(lines[i].lstrip()) != depth:
                i += 1
            i += 1
    return float(lines[i].split(":")[1])


def isotonic(points: list[tuple[float, float]]):
    """Boundaries and values of the increasing map that fits (x, y) best: equal x are one, violating neighbours are pooled."""
    by_x = collections.defaultdict(list)
    for x, y in points:
        by_x[x].append(y)
    pools = []  # first x, last x, sum, count
    for x in sorted(by_x):
        pools.append([x, x, sum(by_x[x]), len(by_x[x])])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, last, s, n = pools.pop()
            pools[-1][1:] = [last, pools[-1][2] + s, pools[-1][3] + n]
    xs = [x for p in pools for x in p[:2]]
    return xs, [p[2] / p[3] for p in pools for _ in range(2)]
