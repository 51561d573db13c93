"""The whole pipeline against plain loops over its stages, on a small table with awkward rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

import plain
from tallyspark.llm import decontaminate, langid


def make_tables():
    r = random.Random(11)
    parts = {"aa": ["the", "ing", "and", "ther", "ou"], "bb": ["ñó", "ción", "las", "qu", "el"]}

    def words(k, n):
        return ["".join(r.choice(parts[k]) for _ in range(r.choice([1, 2, 3]))) for _ in range(n)]

    items = [" ".join(words("aa", 9)), " ".join(words("bb", 12)), "QUX 42"]
    rows = []
    for i in range(60):
        k = "ab"[i % 2] * 2
        body = words(k, r.choice([4, 30, 80]))
        if i % 10 == 7:
            body = rows[i - 2][1].split("\n")[1].split(" ") + [f"ther{i}"]  # a near copy
        if i % 10 == 4:
            item = items[i // 10 % 3]
            body[2:2] = [item.upper() if i % 20 == 4 else item[:20] + item[21:]]
        lines = [f"menu of {k} s{i % 3}" if i % 4 else words(k, 1)[0], " ".join(body), "  ", "contact us" if i % 3 == 0 else ""]
        rows.append((i, "\n".join(lines), k if i % 9 else None, f"s{i % 3}" if i % 11 else None, i))
    rows += [rows[5], rows[5], (100, rows[8][1], "aa", "s1", 0), (101, None, "aa", "s0", 0), (102, "", None, None, None), (103, "語" * 60, None, "s1", 1), (104, "12 34 !", "aa", "s1", 1)]
    rows += [(105, " ".join(words("bb", 3000)), "bb", "s2", 9), (106, "the and ou\nthe and ou", "aa", None, None)]
    return rows, items


def after_language_id(rows, model):
    train = [plain.hashed_grams(t, langid.DIMENSIONS) for i, t, k, *_ in rows if k is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    seen = collections.Counter(d for c in train for d in c)
    idf = {d: math.log((len(train) + 1) / (seen[d] + 1)) + 1 for d in range(langid.DIMENSIONS)}
    out = []
    for row in rows:
        if any(c.isalpha() for c in row[1] or ""):
            counts = plain.hashed_grams(row[1], langid.DIMENSIONS)
            v = plain.tf_idf(counts, idf)
            near, of = max((sum(x * float(c[d]) for d, x in v.items()), k) for c, k in zip(model.centroids, model.of, strict=True))
            limit = model.limit[of, int(math.log2(sum(counts.values())))]
            assert abs(near - limit) > 1e-5
            out += [row] * int(near >= limit)
    return out


def after_line_dedup(rows):
    pages, seen = collections.Counter(), collections.Counter()
    for _, t, _, s, _ in rows:
        pages[s] += 1
        seen.update({(s, x) for x in t.split("\n") if x.strip()})
    drop = {k for k, n in seen.items() if n >= 3 and n > 0.1 * pages[k[0]]}
    assert drop
    return [(i, "\n".join(x for x in t.split("\n") if (s, x) not in drop), k, s, n) for i, t, k, s, n in rows]


def after_near_duplicates(rows):
    sets = {}
    for i, t, *_ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    part, changed = {i: i for i in sets}, True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if part[b] < part[a] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    part[a] = part[b]
                    changed = True
    kept = {row[0]: row for row in rows if part[row[0]] == row[0]}
    assert len(kept) < len({x[0] for x in rows})
    return list(kept.values())


def appears(item, text, edits):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row) <= edits


def after_decontamination(rows, items):
    def folded(t):
        return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"[\t-\r]", " ", t))

    long = [x for x in items if len(x) >= decontaminate.Q]
    edits = decontaminate.build(range(len(long)), long).edits
    short = [x for x in items if len(x) < decontaminate.Q]
    kept = []
    for row in rows:
        t = folded(row[1])
        hit = any(appears(folded(x), t, e) for x, e in zip(long, edits, strict=True)) or any(re.search(rf"(?<!\w){re.escape(folded(x))}(?!\w)", t) for x in short)
        kept += [row] * (not hit)
    assert len(kept) < len(rows)
    return kept


def test_pipeline_equals_plain_loops(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows, items = make_tables()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*enumerate(items), (9, None), (None, "contact us now")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    model = langid.fit(docs.where(~langid.held_out()).select("lang", "text"))

    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    expect = rows
    after = [lambda x: after_language_id(x, model), after_line_dedup, after_near_duplicates, lambda x: after_decontamination(x, items)]
    for (name, stage), plainly in zip(corpus_pipeline.STAGES[:-1], after, strict=True):
        now, expect = stage(spark, now, str(tmp_path)), plainly(expect)
        assert collections.Counter(map(tuple, now.collect())) == collections.Counter(expect), name

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for i, t, *_ in expect:
        want[i] = tokenizer.encode(t, add_special_tokens=False).ids + [0]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(want) and max(map(len, want.values())) > 2048
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and all(r.length == 2048 for r in pieces[1:])
        assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1]) and sum(r.length for r in pieces) == len(want[i])
        assert all(r.ids_crc32 == zlib.crc32(np.array(want[i][r.start : r.start + r.length], "<u4").tobytes()) for r in pieces)
    for places in by_sequence.values():
        places.sort()
        assert [a for a, _ in places] == list(np.cumsum([0, *(n for _, n in places)])[:-1]) and sum(n for _, n in places) <= 2048
    assert len(by_sequence) <= math.ceil(sum(map(len, want.values())) / 2048) + 1
