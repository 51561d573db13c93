"""Language ID by nearest centroid.

A text becomes a vector of its character 1- to 3-grams (letters folded, runs of others as a
space), hashed to ``DIMENSIONS``, weighted by TF-IDF and normalised.  Each language has several
centroids from spherical k-means, and a text gets the language of the centroid with the largest
cosine.  A text is rejected if its cosine is more than ``margin`` below the ``quantile`` (1 %) of
the cosines of its language's training texts of about its length.

Document frequencies and limits cover all training texts.  Centroids are fitted on a sample of
at most ``sample`` distinct training texts: as many of each language that has a text with a
letter, those of the least hashes, however many copies a text has.  Null texts and texts without a letter are ``und`` with score
0 and are rejected.  Rows with null languages are not learned from.  Rows with null or repeated
ids are predicted each on their own.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import row_of, written
from .textblocks import U, codepoints, mix, slices

DIMENSIONS, CENTROIDS, SAMPLE = 4096, 4, 2000
#: Bytes and rows of a slice: a row of counts takes DIMENSIONS numbers however short its text is.
SLICE, ROWS = 256 << 10, 256
LENGTHS, BINS = 32, 256
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else a space."""
    if not _tables:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _tables.append(table)
    return _tables[0]


def counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of n-gram counts for each document, and whether it has a letter."""
    points, at = codepoints(data, off)
    x = _letters()[points]
    docs = len(off) - 1
    doc = np.repeat(np.arange(docs), np.diff(at))
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (doc[1:] != doc[:-1])
    x, doc = x[keep], doc[keep]
    out = np.zeros(docs * DIMENSIONS, np.int32)
    code = x.astype(np.uint64)
    for n in (1, 2, 3):
        if n > 1:
            code = (code[:-1] << U(21)) | x[n - 1 :]
        inside = doc[: len(code)] == doc[n - 1 :] if len(code) else np.zeros(0, bool)
        dim = (mix(code + U(n)) & U(DIMENSIONS - 1)).astype(np.int64)
        out += np.bincount(doc[: len(code)][inside] * DIMENSIONS + dim[inside], minlength=docs * DIMENSIONS).astype(np.int32)
    return out.reshape(docs, DIMENSIONS), np.bincount(doc[x != 32], minlength=docs) > 0


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    of: np.ndarray
    centroids: np.ndarray
    limit: np.ndarray

    def vectors(self, n: np.ndarray) -> np.ndarray:
        v = np.log1p(n, dtype=np.float32) * self.idf
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return v / np.maximum(norm, 1e-12)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and cosine of the nearest centroid; the first of equals."""
        cosine = v @ self.centroids.T
        best = cosine.argmax(axis=1)
        return self.of[best], cosine[np.arange(len(v)), best]


def _kmeans(v: np.ndarray, k: int, rounds: int = 12, least: float = 0.02) -> np.ndarray:
    """Spherical k-means, seeded by k-means++; clusters of under ``least`` of the texts, or of one text, go to their neighbours."""
    r = np.random.default_rng(0)
    chosen = [int((v @ v.mean(axis=0)).argmax())]
    near = v @ v[chosen[0]]
    while len(chosen) < min(k, len(v)):
        far = np.maximum(1 - near.astype(float), 0)
        if far.sum() < 1e-6 * len(v):
            break
        chosen.append(int(r.choice(len(v), p=far / far.sum())))
        near = np.maximum(near, v @ v[chosen[-1]])
    c = v[chosen]
    while True:
        for _ in range(rounds):
            best = (v @ c.T).argmax(axis=1)
            c = np.stack([v[best == j].mean(axis=0) if (best == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        size = np.bincount((v @ c.T).argmax(axis=1), minlength=len(c))
        if len(c) == 1 or size.min() >= max(2, least * len(v)):
            return c
        c = np.delete(c, size.argmin(), axis=0)


def _length(n: np.ndarray) -> np.ndarray:
    """The length class of each row of counts: the binary logarithm of how many n-grams it has."""
    return np.minimum(np.log2(np.maximum(n.sum(axis=1), 1)).astype(int), LENGTHS - 1)


def _limits(histogram: np.ndarray, quantile: float, enough: int) -> np.ndarray:
    """For each length class the low quantile of a histogram (class, cosine); classes of fewer rows than ``enough`` take their neighbours in."""
    out = np.zeros(len(histogram))
    for at in range(len(histogram)):
        for reach in range(len(histogram)):
            h = histogram[max(0, at - reach) : at + reach + 1].sum(axis=0)
            if h.sum() >= enough:
                break
        # the lowest of a few texts doesn't set the limit alone
        rank = max(int(quantile * h.sum()), min(1, int(h.sum()) - 1))
        out[at] = np.searchsorted(np.cumsum(h), rank, "right") / h.shape[0]
    return out


def fit(train: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, margin: float = 0.1, quantile: float = 0.01, enough: int = 200) -> Model:
    """A model of train(lang, text); languages in order, with at most ``sample`` distinct texts over all of them for the centroids, and one of each language at least."""
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequency(batches):
        total, n, least = np.zeros(DIMENSIONS, np.int64), 0, {}
        for batch in batches:
            lang, key = np.array(batch.column("lang").to_pylist(), object), batch.column("key").to_numpy(zero_copy_only=False)
            for i, j, data, off in slices(batch.column("text"), SLICE, ROWS):
                found, letters = counts(data, off)
                total += (found > 0).sum(axis=0)
                n += j - i
                for name in set(lang[i:j][letters]):
                    new = key[i:j][letters & (lang[i:j] == name)]
                    least[name] = np.unique(np.r_[least.get(name, new[:0]), new])[:sample]
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.nulls(len(at) + 1, pa.string()), pa.array(np.r_[at, -1].astype(np.int64)), pa.array(np.r_[total[at], n])], ["lang", "key", "n"])
        for name, keys in least.items():
            yield pa.record_batch([pa.array([name] * len(keys)), pa.array(keys), pa.array(np.ones(len(keys), np.int64))], ["lang", "key", "n"])

    keyed = train.select("lang", F.xxhash64("text").alias("key"), "text")
    seen = written(keyed.mapInArrow(frequency, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))
    df = {r["key"]: r["n"] for r in seen.where("lang is null").collect()}
    documents = df.pop(-1, 0)
    frequencies = np.zeros(DIMENSIONS)
    for dim, n in df.items():
        frequencies[dim] = n
    model = Model(np.log((documents + 1) / (frequencies + 1)).astype(np.float32) + 1, [], np.zeros(0, int), np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, LENGTHS)))
    usable = seen.where("lang is not null").select("lang", "key")
    per = [r["lang"] for r in usable.select("lang").distinct().collect()]
    each = max(1, sample // max(1, len(per)))

    def first(batches):
        least = {}
        for batch in batches:
            lang, key = np.array(batch.column("lang").to_pylist(), object), batch.column("key").to_numpy(zero_copy_only=False)
            for name in set(lang):
                least[name] = np.unique(np.r_[least.get(name, key[:0]), key[lang == name]])[:each]
        for name, keys in least.items():
            yield pa.record_batch([pa.array([name] * len(keys)), pa.array(keys)], ["lang", "key"])

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = usable.mapInArrow(first, "lang string, key long").withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "key")
    # at most ``sample`` rows, or one for each language
    rows = keyed.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text")).orderBy("lang", "key").collect()
    of, all_centroids = [], []
    for lang in sorted(per):
        texts = pa.array([r["text"] for r in rows if r["lang"] == lang], pa.string())
        held = [(n, ok) for _, _, data, off in slices(texts, SLICE, ROWS) for n, ok in [counts(data, off)]]
        if not held or not any(ok.any() for _, ok in held):
            continue
        v = np.concatenate([model.vectors(n[ok]) for n, ok in held])
        c = _kmeans(v, centroids)
        of += [len(model.languages)] * len(c)
        model.languages.append(lang)
        all_centroids.append(c)
    if not all_centroids:
        return model
    model.of, model.centroids = np.array(of), np.concatenate(all_centroids).astype(np.float32)
    shared = train.sparkSession.sparkContext.broadcast(model)

    def cosines(batches):
        m = shared.value
        number = {name: i for i, name in enumerate(m.languages)}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            lang = np.array([number.get(x, -1) for x in batch.column("lang").to_pylist()])
            for i, j, data, off in slices(batch.column("text"), SLICE, ROWS):
                n, letters = counts(data, off)
                v, length = m.vectors(n), _length(n)
                for k in np.unique(lang[i:j][letters]):
                    if k >= 0:
                        at = letters & (lang[i:j] == k)
                        near = (v[at] @ m.centroids[m.of == k].T).max(axis=1)
                        cell = length[at] * BINS + np.clip(near * BINS, 0, BINS - 1).astype(int)
                        total[k] = total.get(k, 0) + np.bincount(cell, minlength=LENGTHS * BINS)
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["of", "cell", "n"])

    histogram: dict[int, np.ndarray] = {}
    # at most LENGTHS * BINS rows a language
    for of_, cell, n in train.select("lang", "text").mapInArrow(cosines, "of int, cell int, n long").groupBy("of", "cell").agg(F.sum("n")).collect():
        histogram.setdefault(of_, np.zeros(LENGTHS * BINS, np.int64))[cell] = n
    model.limit = np.stack([np.maximum(_limits(histogram[k].reshape(LENGTHS, BINS), quantile, enough) - margin, 0) for k in range(len(model.languages))])
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected beside their other columns, of which those named so are replaced."""
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(row_of(c for c in docs.columns if c not in ("lang_pred", "score", "rejected")), F.col(text_col).alias("text"))

    def name(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            for i, j, data, off in slices(batch.column("text"), SLICE, ROWS):
                n, letters = counts(data, off)
                of, cosine = m.nearest(m.vectors(n)) if len(m.of) else (np.zeros(j - i, int), np.zeros(j - i))
                letters = letters & (len(m.of) > 0)
                far = ~letters | (cosine < (m.limit[of, _length(n)] if len(m.of) else 0))
                yield pa.record_batch([batch.column("row").slice(i, j - i), pa.array(names[np.where(letters, of, -1)].tolist()), pa.array(np.where(letters, np.clip(cosine, 0, 1), 0).astype(float)), pa.array(far)], ["row", "lang_pred", "score", "rejected"])

    schema = StructType().add("row", rows.schema["row"].dataType).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    return rows.mapInArrow(name, schema).select("row.*", "lang_pred", "score", "rejected")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))
