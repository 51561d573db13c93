"""Best-fit packing of token pieces into sequences by exact-complement hashing.

A piece's length is at most the sequence length, so the plan is made on the histogram of
lengths, whose size does not grow with the data.  The lengths there are, and the sums of two and
of three of them, are indexed by the sum.  For each length, longest first, the gap that it leaves
is looked up there, and every combination found is used as often as its lengths are available.  What is left goes best-fit: each length
into the smallest open gap that takes it.  A plan is a list of runs (lengths of a sequence,
number of such sequences), and each run uses up a length or a gap.

Pieces then take the places of their length in the order of a rank that is counted in salted
buckets, so a length that a third of all pieces have is not ranked in one task.

A null text is an empty text: its only token is the end id.  Rows that repeat an id, or have a
null one, are packed each on their own; which of two equal pieces takes which place is open.  An
empty table gives no row.  Very long texts are cut into as many pieces as they take.  Columns of
documents beside id and text are left out, whatever their names; ``pack`` keeps other columns of
its table and replaces those named sequence_id and offset.  A literal of one of the tokenizer's
added tokens in a text is that token, as in tokenizers by default.
"""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written

CAPACITY, END = 2048, 0


class Sums:
    """The available lengths (counts c) by the sums of one, two and three of them, addressed by the sum."""

    def __init__(self, c: np.ndarray):
        self.c, self.lengths = c, np.flatnonzero(c)
        x, top = self.lengths.astype(np.int32), len(c) - 1
        larger = [x[i : np.searchsorted(x, top - b, "right")] for i, b in enumerate(x.tolist())]
        a, total = (np.concatenate([x[:0], *k]) for k in (larger, [k + b for k, b in zip(larger, x.tolist(), strict=True)]))
        order = np.lexsort((-a, total))
        #: the larger lengths of the pairs, by their sum, and where each sum's begin
        self.larger, self.at = a[order].astype(np.int16), np.searchsorted(total[order], np.arange(top + 2))

    def larger_of(self, gap: int) -> list[int]:
        return self.larger[self.at[gap] : self.at[gap + 1]].tolist() if gap > 0 else []

    def single(self, gap: int):
        if 0 < gap < len(self.c) and self.c[gap]:
            yield (gap,)

    def pair(self, gap: int):
        """Pairs of available lengths of this sum, the most unequal first."""
        for a in self.larger_of(gap):
            if self.c[a] and self.c[gap - a]:
                yield a, gap - a

    def triple(self, gap: int):
        """A triple is a length and a pair of none longer; the longest first."""
        for x in self.lengths[::-1].tolist():
            if x < gap and self.c[x] and 3 * x >= gap:
                for a in self.larger_of(gap - x):
                    if a <= x and self.c[x] and self.c[a] and self.c[gap - x - a]:
                        yield x, a, gap - x - a


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths of a sequence, number of such sequences) that hold counts[length] pieces of each length."""
    c = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        c[length] = n
    runs = []

    def use(*lengths):
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        n = min(int(c[x]) // k for x, k in need.items())
        if n > 0:
            for x, k in need.items():
                c[x] -= n * k
            runs.append((lengths, n))

    use(capacity)
    sums = Sums(c)
    for fill in (sums.single, sums.pair, sums.triple):
        for long in sums.lengths[::-1].tolist():
            if c[long] and long < capacity:
                for lengths in fill(capacity - long):
                    if lengths[0] <= long:
                        use(long, *lengths)
                    if not c[long]:
                        break
    gaps: dict[int, list] = defaultdict(list)
    free = np.zeros(capacity + 1, bool)
    for x in np.flatnonzero(c)[::-1].tolist():
        n = int(c[x])
        while n:
            at = np.flatnonzero(free[x:])
            if len(at):
                g = x + int(at[0])
                held, m = gaps[g].pop()
                k = min(n, m)
                if k < m:
                    gaps[g].append((held, m - k))
                free[g] = bool(gaps[g])
                new, n = (*held, x), n - k
            else:
                each = min(capacity // x, n)
                k = n // each
                new, g, n = (x,) * each, capacity - x * (each - 1), n - k * each
            gaps[g - x].append((new, k))
            free[g - x] = g - x > 0
    return runs + [x for held in gaps.values() for x in held]


def _tokenizer(path: str, pattern: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken, which gives the same ids several times as fast."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    vocab = held["model"]["vocab"]
    special = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte[ch] for ch in token): i for token, i in vocab.items() if all(ch in byte for ch in token) and not token.startswith("<|")}
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """doc, piece, start, length, ids_crc32 and, with keep_ids, ids: documents' tokens, of which those of long ones are cut so that all pieces but the first are full."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def cut(batches):
        encode = _tokenizer(tokenizer, pattern).encode_to_numpy
        for batch in batches:
            doc, texts = batch.column("doc").to_pylist(), batch.column("text")
            out = defaultdict(list)
            for i, d in enumerate(doc):
                ids = np.append(encode(texts[i].as_py(), allowed_special="all", disallowed_special=()), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, a in enumerate([0, *range(first, len(ids), capacity)]):
                    b = first if k == 0 else a + capacity
                    for name, x in (("doc", d), ("piece", k), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(ids[a:b].tobytes()))):
                        out[name].append(x)
                    if keep_ids:
                        out["ids"].append(ids[a:b].astype(np.int32))
                if len(out["doc"]) >= (256 if keep_ids else 10_000):
                    yield _batch(out, keep_ids)
                    out = defaultdict(list)
            if out["doc"]:
                yield _batch(out, keep_ids)

    return rows.mapInArrow(cut, schema)


def _batch(out, keep_ids):
    kinds = {"doc": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if keep_ids else {})
    return pa.record_batch([pa.array(out[k], v) for k, v in kinds.items()], list(kinds))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (a table with doc, piece, length, as pieces() returns it) with sequence_id and offset."""
    spark = cut.sparkSession
    cut = written(cut.drop("sequence_id", "offset"))
    buckets = partitions(spark)
    salted = cut.withColumn("bucket", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = written(salted.groupBy("length", "bucket").count())
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = plan(histogram, capacity)
    used, base, places = defaultdict(int), 0, []
    for lengths, n in runs:
        offset = 0
        for x in lengths:
            places.append((x, used[x], base, offset))
            used[x] += n
            offset += x
        base += n
    places.sort()
    shared = spark.sparkContext.broadcast(np.array(places, np.int64).reshape(-1, 4))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(own) - 1).join(before, ["length", "bucket"]).withColumn("_rank", F.col("_rank") + F.col("before")).drop("before", "bucket")

    def place(batches):
        table = shared.value
        starts = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(starts, (length << 44) + rank, "right") - 1
            keep = [c for c in batch.schema.names if c != "_rank"]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])], [*keep, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([f for f in ranked.schema.fields if f.name != "_rank"] + [StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(place, schema)
