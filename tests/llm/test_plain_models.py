"""Language ID and toxicity against plain versions of their models."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from tallyspark.llm import langid, toxicity


def make_texts():
    r = random.Random(6)
    parts = {"aa": ["the", "ing", "And", "ther", "é"], "bb": ["ñó", "ción", "las", "qu", "the"], "cc": ["ung", "sch", "ß", "ein", "İx"]}
    rows = [(k, " ".join("".join(r.choice(parts[k]) for _ in range(3)) + r.choice(["", ",", " 12", "\n"]) for _ in range(r.choice([2, 9, 40])))) for k in parts for _ in range(120)]
    rows += [("aa", "the"), ("aa", ""), ("bb", "12 !"), ("cc", "ein " * 3000), ("cc", rows[-1][1]), (None, "abc"), ("aa", None)]
    return rows


@pytest.mark.parametrize("enough", [5, 200])
def test_langid_is_tf_idf_cosine_and_limits(spark, enough):
    rows = make_texts()
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "doc_id long, lang string, text string")
    model = langid.fit(df.select("lang", "text"), enough=enough)
    train = [(k, plain.hashed_grams(t, langid.DIMENSIONS), t) for k, t in rows if k is not None and t is not None]
    seen = collections.Counter(d for _, c, _ in train for d in c)
    idf = {d: math.log((len(train) + 1) / (seen[d] + 1)) + 1 for d in range(langid.DIMENSIONS)}
    assert np.allclose(model.idf, [idf[d] for d in range(langid.DIMENSIONS)], atol=1e-5)
    assert model.languages == ["aa", "bb", "cc"] and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)

    def cosines(counts):
        v = plain.tf_idf(counts, idf)
        return [sum(x * float(c[d]) for d, x in v.items()) for c in model.centroids]

    def length(counts):
        return int(math.log2(max(1, sum(counts.values()))))

    cells = collections.defaultdict(list)
    for k, counts, t in train:
        if any(c.isalpha() for c in t):
            near = max(x for x, of in zip(cosines(counts), model.of, strict=True) if model.languages[of] == k)
            cells[k].append((length(counts), min(255, int(near * 256))))
    for j, k in enumerate(model.languages):
        for at in range(langid.LENGTHS):
            reach = next((x for x in range(langid.LENGTHS) if sum(abs(c - at) <= x for c, _ in cells[k]) >= enough), langid.LENGTHS - 1)
            bins = sorted(b for c, b in cells[k] if abs(c - at) <= reach)
            expect = max(0, bins[max(int(0.01 * len(bins)), min(1, len(bins) - 1))] / 256 - 0.1)
            assert abs(model.limit[j, at] - expect) < 1.5 / 256  # a cosine at the edge of a bin
    # tied, repeated, unseen and long texts beside those learned from; null and repeated ids
    more = [(7, None, rows[3][1]), (7, None, rows[3][1]), (None, None, "語" * 50), (None, None, "Qwx zz 9"), (8, None, "the sch " * 5000)]
    asked = [(i, k, t) for i, (k, t) in enumerate(rows)] + more
    got = langid.predict(spark.createDataFrame(asked, df.schema), model).collect()
    assert len(got) == len(asked)
    assert collections.Counter((x.doc_id, x.text) for x in got) == collections.Counter((i, t) for i, _, t in asked)
    for x in got:
        if not any(c.isalpha() for c in x.text or ""):
            assert (x.lang_pred, x.score, x.rejected) == ("und", 0, True)
            continue
        counts = plain.hashed_grams(x.text, langid.DIMENSIONS)
        all_of = cosines(counts)
        best = max(all_of)
        assert abs(x.score - min(1, max(0, best))) < 1e-4
        assert x.lang_pred in {model.languages[of] for c, of in zip(all_of, model.of, strict=True) if c > best - 1e-5}
        limit = model.limit[model.languages.index(x.lang_pred), length(counts)]
        assert abs(best - limit) < 1e-4 or x.rejected == (best < limit)
    assert langid.predict(df.limit(0), model).count() == 0


def test_toxicity_is_trees_walked_and_neighbours_pooled(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import IsotonicRegression

    fitted = {}

    def kept(cls):
        fit = cls.fit
        monkeypatch.setattr(cls, "fit", lambda self, df: fitted.setdefault(cls, fit(self, df)))

    kept(GBTClassifier)
    kept(IsotonicRegression)
    r = random.Random(1)
    rows, labels = [], []
    for i in range(1200):
        w = [r.choice(["you", "IT", *(f"n{k}ce" for k in range(200))]) for _ in range(r.choice([3, 30, 90]))]
        bad = r.random() < 0.4
        if bad:
            w[r.randrange(len(w))] = r.choice(["idiot", "MORON!", "1d1ot", "zzinsulting", "fine"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad) if r.random() < 0.9 else int(not bad)))
    rows += [(4000, None), (4001, ""), (4002, "you idiot " * 20_000), (4002, "you idiot " * 20_000), (None, "you moron"), (5, "other text of id 5")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("words", F.lit(None))
    truth = spark.createDataFrame([*labels, (6, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(df, truth, lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(4))).collect()
    assert len(got) == len(rows) and collections.Counter(x.doc for x in got) == collections.Counter(i for i, _ in rows)
    model = fitted[GBTClassifier]
    trees = [t.toDebugString.splitlines()[1:] for t in model.trees]
    assert len(trees) == 12 and max(t.depth for t in model.trees) == 3

    def raw(x):
        margin = sum(w * plain.walk(t, [x[c] for c in toxicity.FEATURES]) for w, t in zip(model.treeWeights, trees, strict=True))
        return 1 / (1 + math.exp(-2 * margin))

    label = {}
    for i, t in [*labels, (6, 1)]:
        label[i] = max(t, label.get(i, 0))
    points = [(round(raw(x), 12), label[x.doc]) for x in got if x.fold == 3 and x.doc in label]
    xs, ys = plain.isotonic(points)
    assert len(points) > 200 and len(set(ys)) > 2
    for x in got:
        expect = float(np.interp(round(raw(x), 12), xs, ys))
        assert abs(x.score - expect) < 1e-6 and x.predicted == int(x.score >= 0.3)
    assert len({x.score for x in got if x.doc == 4002}) == 1 and {x.score for x in got if x.doc in (4000, 4001)} <= {x.score for x in got if x.words == 0}
    same = {x.doc: x for x in toxicity.score(df.drop("score", "words"), truth, lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(4))).collect()}
    assert all(abs(same[x.doc].score - x.score) < 1e-9 for x in got if x.doc not in (None, 5))
    assert toxicity.score(df.limit(0), truth, lambda c: F.lit(0)).count() == 0
