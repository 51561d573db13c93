"""Quality rules with a character n-gram perplexity band for each language.

The n-grams are of code points, none folded together, so the model grows with the corpus.
Spark counts the four-grams of all texts, and from these counts come the continuation counts,
discounts and probabilities of a modified Kneser-Ney model, as tables dealt by language and
n-gram.  A text must not vouch for itself: texts are dealt into two folds by their hash (copies
into the same), and each is scored by the model of the other fold.

To score, documents are dealt into blocks of one language of about ``BLOCK`` characters, packed
and compressed before they are shuffled; the distinct four-grams of a block are joined with the
model, and the block's documents look theirs up in sorted arrays of hashes of what comes back.
So no task holds more of the model than its block asks for.  The number of partitions is the session's, whatever
the number of blocks; four-grams that most blocks ask for make rows of one key, which adaptive execution splits, as the model has
one row for each.

A document's perplexity (for a character) is held against its language's band: between the
quartiles of all documents that pass the base rules, widened by ``fence`` times their distance and, as short texts vary more, by ``slack``
bits over the square root of the text's characters.

The language is the given column, each with a model of its own; null is a language of its own.
A null text is an empty one: it fails the base rules.  Repeated rows, and rows with null or
repeated ids, are each a row of the result; they count as often as they are there.  An empty
table gives no row.  Very long texts are scored whole.  Ties at a band's edge are inside it.
Only the id of a row passes through, as doc_id; columns beside id, text and language are left out,
whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written
from .textblocks import STEP, U, WHITE, Words, codepoints, grams, mix, per_doc_sum, per_document, slices, span_hashes

ORDER = 4
#: Bits of a code point, and their number.
BITS, POINTS = 21, 0x110000
BLOCK = 4 << 20
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
OTHER = "\x00other"


def base_metrics(data, off) -> dict[str, np.ndarray]:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = Words(data, off)
    word = ~WHITE[data]
    out = {"n_words": w.count, "word_chars": per_doc_sum(word & ((data & 0xC0) != 0x80), off), "n_symbols": per_doc_sum(SYMBOL[data], off)}
    cut = np.unique(np.r_[off, np.flatnonzero(data == 10) + 1])
    start, end = cut[:-1], cut[1:].copy()
    end[data[end - 1] == 10] -= 1
    seen = np.r_[0, np.cumsum(word)]
    full = seen[end] > seen[start]
    start, end = start[full], end[full]
    doc = np.searchsorted(off, start, "right") - 1
    distinct = per_document(span_hashes(data, start, end), doc)[1]
    docs = len(off) - 1
    out["n_dup_lines"] = np.bincount(doc, minlength=docs) - np.bincount(distinct, minlength=docs)
    g, valid = grams(w.hashes(), w.doc, 5)
    at = np.flatnonzero(valid)
    order = np.lexsort((g[at], w.doc[at]))
    h, d = g[at][order], w.doc[at][order]
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1]) if len(h) else np.zeros(0, bool)
    twice = at[order][np.r_[same, False] | np.r_[False, same]] if len(h) else at
    cover = np.zeros(len(w.start) + 6, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    out["n_repeat_words"] = np.diff(np.r_[0, np.cumsum(np.cumsum(cover)[: len(w.start)] > 0)][w.first])
    return out


def _windows(data, off) -> tuple[list[np.ndarray], np.ndarray]:
    """The three code points before each character and the character, and the documents' offsets in them; before a text stand spaces."""
    points, chars = codepoints(data, off)
    lengths = np.diff(chars)
    padded = np.full(len(points) + (ORDER - 1) * len(lengths), 32, np.uint32)
    at = np.arange(len(points)) + (ORDER - 1) * (np.repeat(np.arange(len(lengths)), lengths) + 1)
    padded[at] = points
    return [padded[at - k] for k in range(ORDER - 1, -1, -1)], chars


def _distinct(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct four-grams as a context of three code points and a last one, and how often each is there."""
    number = np.zeros(POINTS, np.uint64)
    for c in x:
        number[c] = 1
    letters = np.flatnonzero(number).astype(np.uint64)
    if len(letters) > 1 << 16:  # a repeated four-gram is added up later
        half = len(x[0]) // 2
        return tuple(np.concatenate(y) for y in zip(_distinct([c[:half] for c in x]), _distinct([c[half:] for c in x]), strict=True))
    number[letters] = np.arange(len(letters), dtype=np.uint64)
    code = number[x[0]]
    for c in x[1:]:
        code = (code << U(16)) | number[c]
    code, n = np.unique(code, return_counts=True)
    a, b, c, d = (letters[(code >> U(16 * k)) & U(0xFFFF)] for k in (3, 2, 1, 0))
    return ((a << U(2 * BITS)) | (b << U(BITS)) | c).view(np.int64), d.astype(np.int32), n


def _hash(context: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(mix(context.astype(np.uint64)) + last.astype(np.uint64) * STEP)


def _fold_rows(batches):
    """The distinct four-grams of the texts of each language and fold."""
    for batch in batches:
        lang, fold = batch.column("lang").to_pylist(), batch.column("fold").to_numpy()
        for i, j, data, off in slices(batch.column("text"), BLOCK):
            x, chars = _windows(data, off)
            key = list(zip(lang[i:j], fold[i:j].tolist(), strict=True))
            names = {name: k for k, name in enumerate(dict.fromkeys(key))}
            of = np.repeat(np.array([names[name] for name in key]), np.diff(chars))
            for (name, side), k in names.items():
                context, last, n = _distinct([c[of == k] for c in x] if len(names) > 1 else x)
                got = pa.table({"lang": pa.array([name] * len(n), pa.string()), "fold": np.full(len(n), side, np.int32), "context": context, "last": last, "n": n})
                yield from got.to_batches(max_chunksize=50_000)


CODEC = pa.Codec("zstd", 3)


def _pack(batches):
    """A compressed row for the texts that a batch has of each block."""
    for batch in batches:
        lang, block, fold = batch.column("lang").to_pylist(), batch.column("block").to_numpy(), batch.column("fold").to_numpy().astype(np.uint8)
        doc = batch.column("doc")
        known, doc = np.array(doc.is_valid()).astype(np.uint8), doc.fill_null(0).to_numpy()
        raw = [x.as_buffer() if x.is_valid else b"" for x in batch.column("text").cast(pa.large_binary())]
        held: dict[tuple, list[int]] = {}
        for r, key in enumerate(zip(lang, block.tolist(), strict=True)):
            held.setdefault(key, []).append(r)
        for (name, b), rows in held.items():
            at = np.array(rows)
            body = b"".join([np.array([len(at)]).tobytes(), doc[at].tobytes(), np.array([len(raw[r]) for r in rows], np.int64).tobytes(), known[at].tobytes(), fold[at].tobytes(), *(raw[r] for r in rows)])
            yield pa.record_batch([pa.array([name], pa.string()), pa.array([b], pa.int32()), pa.array([len(body)], pa.int64()), pa.array([CODEC.compress(body, asbytes=True)], pa.binary())], ["lang", "block", "size", "packed"])


def _unpack(packed: bytes, size: int):
    """doc, whether it is known, fold, bytes and offsets of the texts of a packed row."""
    body = np.frombuffer(CODEC.decompress(packed, size), np.uint8)
    n = int(body[:8].view(np.int64)[0])
    doc, length = body[8 : 8 + 8 * n].view(np.int64), body[8 + 8 * n : 8 + 16 * n].view(np.int64)
    at = 8 + 16 * n
    return doc, body[at : at + n] > 0, body[at + n : at + 2 * n], body[at + 2 * n :], np.r_[0, np.cumsum(length)]


def _block_rows(batches):
    """The distinct four-grams of each block, or of each BLOCK bytes of a larger one, from packed rows sorted by block."""
    key, held, n = None, [], 0

    def result():
        context, last, _ = _distinct([np.concatenate(c) for c in zip(*held, strict=True)])
        got = pa.table({"lang": pa.array([key[0]] * len(last), pa.string()), "block": np.full(len(last), key[1], np.int32), "context": context, "last": last})
        yield from got.to_batches(max_chunksize=50_000)

    for batch in batches:
        for lang, block, size, packed in zip(batch.column("lang").to_pylist(), batch.column("block").to_pylist(), batch.column("size").to_pylist(), batch.column("packed"), strict=True):
            if held and (key != (lang, block) or n >= BLOCK):
                yield from result()
                held, n = [], 0
            key = (lang, block)
            *_, data, off = _unpack(packed.as_buffer(), size)
            held.append(_windows(data, off)[0])
            n += len(data)
    if held:
        yield from result()


def count_ngrams(rows: DataFrame) -> DataFrame:
    """lang, context, last, out0, out1: the four-grams of rows(lang, fold, text), counted outside each fold."""
    got = rows.select("lang", "fold", "text").mapInArrow(_fold_rows, "lang string, fold int, context long, last int, n long")
    outside = [F.sum(F.when(F.col("fold") != i, F.col("n")).otherwise(0)).alias(f"out{i}") for i in (0, 1)]
    return got.groupBy("lang", "context", "last").agg(*outside)


def probabilities(top: DataFrame) -> DataFrame:
    """lang, context, last, log0, log1: log2 of the modified Kneser-Ney probability that last follows context, as the counts outside each fold tell it."""
    tables = [top]
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("context").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("context")
        tables.append(tables[-1].groupBy("lang", shorter, "last").agg(*(F.count_if(F.col(f"out{i}") > 0).alias(f"out{i}") for i in (0, 1))))
    below = None
    for k, t in enumerate(reversed(tables)):
        seen = t.groupBy("lang").agg(*(F.greatest(F.count_if(F.col(f"out{i}") == j), F.lit(1)).alias(f"t{i}{j}") for i in (0, 1) for j in (1, 2, 3, 4)))
        for i in (0, 1):
            y = F.expr(f"t{i}1 / (t{i}1 + 2 * t{i}2)")
            for j, most in ((1, 0.95), (2, 1.9), (3, 2.9)):
                d = F.lit(j) - (j + 1) * y * F.col(f"t{i}{j + 1}") / F.col(f"t{i}{j}")
                seen = seen.withColumn(f"d{i}{j}", F.least(F.greatest(d, F.lit(0.05)), F.lit(most)))
        # a row for each language
        t = t.join(F.broadcast(seen.select("lang", *(f"d{i}{j}" for i in (0, 1) for j in (1, 2, 3)))), "lang")
        whole = Window.partitionBy("lang", "context")
        for i in (0, 1):
            t = t.withColumn(f"off{i}", F.expr(f"case when out{i} = 0 then 0D when out{i} = 1 then d{i}1 when out{i} = 2 then d{i}2 else d{i}3 end"))
        t = t.select("lang", "context", "last", *(c for i in (0, 1) for c in (f"out{i}", f"off{i}", F.sum(f"out{i}").over(whole).alias(f"all{i}"), F.sum(f"off{i}").over(whole).alias(f"rest{i}"))))
        if below is None:
            t = t.withColumn("below0", F.lit(1 / POINTS)).withColumn("below1", F.lit(1 / POINTS))
        else:
            t = t.withColumn("shorter", F.col("context").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)))
            t = t.join(below.select("lang", F.col("context").alias("shorter"), "last", F.col("p0").alias("below0"), F.col("p1").alias("below1")), ["lang", "shorter", "last"])
        p = (F.expr(f"case when all{i} = 0 then below{i} else (out{i} - off{i} + rest{i} * below{i}) / all{i} end").alias(f"p{i}") for i in (0, 1))
        below = t.select("lang", "context", "last", *p)
    return below.select("lang", "context", "last", F.log2("p0").alias("log0"), F.log2("p1").alias("log1"))


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fence: float = 3.0, slack: float = 1.0, min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """doc_id, the base metrics, base_failed, perplexity, lower, upper and kept, a row for each row of docs."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(OTHER))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), lang.alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(text_col), F.lit(2)).cast("int").alias("fold"))
    top = written(count_ngrams(rows))
    # only languages of more than a block, so no more rows than blocks
    sizes = top.groupBy("lang").agg(F.ceil(F.sum(F.col("out0") + F.col("out1")) / BLOCK).alias("blocks")).where("blocks > 1").collect()
    parts = F.create_map(*(F.lit(x) for r in sizes for x in r)) if sizes else F.create_map(F.lit(OTHER), F.lit(1))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc", "text"), F.coalesce(parts[F.col("lang")], F.lit(1))).cast("int"))
    dealt = dealt.mapInArrow(_pack, "lang string, block int, size long, packed binary")
    # a task takes its blocks one after another, so their number does not ask for more tasks
    dealt = dealt.repartition(partitions(docs.sparkSession), "lang", "block")
    asked = dealt.sortWithinPartitions("lang", "block").mapInArrow(_block_rows, "lang string, block int, context long, last int")
    told = asked.join(probabilities(top), ["lang", "context", "last"]).select("lang", "block", "context", "last", "log0", "log1")

    def measure(block: pa.Table, told: pa.Table) -> pa.Table:
        key = _hash(told.column("context").to_numpy(), told.column("last").to_numpy())
        order = np.argsort(key)
        key, logs = key[order], np.stack([told.column(f"log{i}").to_numpy()[order] for i in (0, 1)])
        out = []
        for size, packed in zip(block.column("size").to_pylist(), block.column("packed").to_pylist(), strict=True):
            doc, known, fold, data, off = _unpack(packed, size)
            found, (x, chars) = base_metrics(data, off), _windows(data, off)
            a, b, c, d = (y.astype(np.uint64) for y in x)
            wanted = _hash((a << U(2 * BITS)) | (b << U(BITS)) | c, d)
            at = np.searchsorted(key, wanted)
            if len(wanted) and (at.max() == len(key) or (key[at] != wanted).any()):
                raise ValueError("a four-gram of a block isn't in the model")
            n = np.diff(chars)
            bits = -per_doc_sum(logs[np.repeat(fold, n), at] if len(at) else np.zeros(0), chars) / np.maximum(n, 1)
            out.append(pa.table({"doc": pa.array(doc, mask=~known), "lang": pa.array([block.column("lang")[0].as_py()] * len(n), pa.string()), **{m: found[m].astype(np.int64) for m in METRICS}, "bits": pa.array(bits, mask=n == 0), "chars": n.astype(np.int64)}))
        return pa.concat_tables(out)

    got = dealt.groupBy("lang", "block").cogroup(told.groupBy("lang", "block")).applyInArrow(measure, "doc long, lang string, " + ", ".join(f"{m} long" for m in METRICS) + ", bits double, chars long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    got = written(got.withColumn("base_failed", failed))
    q = got.where("not base_failed").groupBy("lang").agg(F.percentile_approx("bits", [0.25, 0.75], 10_000).alias("q"))
    width = fence * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(0.05))
    bands = q.select("lang", (F.col("q")[0] - width).alias("low"), (F.col("q")[1] + width).alias("high"))
    # a row for each language
    held = got.join(F.broadcast(bands), "lang", "left")
    more = slack / F.sqrt(F.greatest("chars", F.lit(1)))
    held = held.withColumn("low", F.col("low") - more).withColumn("high", F.col("high") + more)
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(True))
    return held.select(F.col("doc").alias("doc_id"), *METRICS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), "low").alias("lower"), F.pow(F.lit(2.0), "high").alias("upper"))
