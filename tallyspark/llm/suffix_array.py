"""Byte-level dedup by a distributed suffix array of the corpus.

A string of ``width`` bytes that starts at two places of the corpus, in one text or in two, is
repeated; every byte covered by such a string is removed at each of its places.

Only suffixes that start at an anchor are sorted.  The anchor of a window of ``width`` bytes is
the leftmost smallest hash among its first ``reach`` eight-byte tokens, so equal windows have it
at the same place.  Windows of one anchor form a unit: the text from its first window to its last,
the place of the anchor in it, and its leading tokens, the bytes from the anchor on that all its
windows hold.  Units whose leading tokens occur once in the corpus start no repeat and stay home.

``repartitionByRange`` samples splitters from the leading tokens and deals the units to as many
ranges as memory-sized buckets need.  A bucket sorts its suffixes by multikey quicksort with eight bytes as one
character: groups equal so far are sorted by their next character, and only ties go on.  The text before
the anchor is sorted likewise, backwards.  A window at distance a before the anchor is repeated if
another unit shares ``width - a`` bytes after and a bytes before it, which both arrays tell by the
common lengths of neighbours.

Leading tokens of more than ``heavy_from`` units are lengthened: the unit is split by the distance of
its windows, in parts whose windows share more bytes, at last into single windows, whose leading
tokens are the window itself.  Those are salted, so that equal ones may fill several
buckets, and the last window of a bucket is compared with the first of the next.  Units with equal
texts within a slice meet there; one of them travels for all.

A null text is empty, and so is its result.  Nulls and repeats among ids change nothing: rows that repeat id
and text are places of their own, so both lose what they share.  Texts below ``width`` bytes keep everything.
Very long texts are worked on in overlapping pieces until they are cut, which takes a few bytes a
byte.  Ties of hashes go to the leftmost.  An empty table gives an empty one.  Other columns
pass through, whatever their names, but for those added, which are replaced.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from .repeats import Repeats, count_repeats
from .shared import partitions, row_of, write, written
from .textblocks import BYTES, U, mix, powers, signed, slices

WIDTH, TOKEN, REACH, PARTS, HEAVY = 200, 8, 137, 8, 20_000
#: Bytes of text worked on at once, and in a bucket.
PIECE, BUCKET = 4 << 20, 16 << 20
MASKS = np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)], np.uint64)
UNITS = "level int, salt long, one long, two long, first long, left int, size int, text binary"
SPANS = "one long, two long, start long, end long"
EDGES = f"{SPANS}, bucket int, edge string, window binary"
ADDED = ("n_bytes", "n_removed", "n_spans", "kept")


class Hashes:
    """Hashes of any byte span of a slice."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = []
        for values in (BYTES, mix(BYTES)):
            c = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * up[: len(data)], out=c[1:])
            self.sums.append(c)

    def of(self, start, end, second: bool = False) -> np.ndarray:
        c = self.sums[second]
        return mix((c[end] - c[start]) * self.down[start] + (end - start).astype(np.uint64))


class Units:
    """Units of a slice: place of the anchor, first and last window, all in its bytes; ``reach`` is how many windows one may have."""

    def __init__(self, hashes: Hashes, width: int, reach: int, at, first, last):
        self.hashes, self.width, self.reach, self.at, self.first, self.last = hashes, width, reach, at, first, last

    @classmethod
    def anchored(cls, data: np.ndarray, off: np.ndarray, width: int, reach: int) -> "Units":
        none = np.zeros(0, np.int64)
        m = len(data) - width + 1
        if m <= 0:
            return cls(Hashes(data), width, reach, none, none, none)
        token, size = data.astype(np.uint64), 1
        while size < TOKEN:
            token = token[: len(token) - size] | (token[size:] << U(8 * size))
            size *= 2
        # the hash above, the place below: the least of them is the leftmost smallest hash
        best = (mix(token) & U(0xFFFFFFFF00000000)) | np.arange(len(token), dtype=np.uint64)
        span = 1
        while span * 2 <= reach:
            best, span = np.minimum(best[: len(best) - span], best[span:]), span * 2
        best = np.minimum(best[:m], best[reach - span : reach - span + m])
        at = (best & U(0xFFFFFFFF)).astype(np.int64)
        # windows that cross the end of a text
        steps = np.zeros(m + 1, np.int32)
        np.add.at(steps, np.minimum(np.maximum(off[1:] - width + 1, off[:-1]), m), 1)
        np.add.at(steps, np.minimum(off[1:], m), -1)
        whole = np.cumsum(steps[:-1]) == 0
        new = whole.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~whole[:-1]
        end = whole.copy()
        end[:-1] &= (at[1:] != at[:-1]) | ~whole[1:]
        first = np.flatnonzero(new)
        return cls(Hashes(data), width, reach, at[first], first, np.flatnonzero(end))

    def where(self, which: np.ndarray) -> "Units":
        return Units(self.hashes, self.width, self.reach, self.at[which], self.first[which], self.last[which])

    @property
    def leading(self) -> int:
        return self.width - self.reach + 1

    def tokens(self) -> np.ndarray:
        """Hashes of the leading tokens."""
        return self.hashes.of(self.at, self.at + self.leading)

    def twins(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether another unit of the slice has the same text and anchor, and whether a unit is the first of such."""
        end = self.last + self.width
        one, two, three = self.hashes.of(self.first, end), self.hashes.of(self.first, end, True), self.at - self.first
        order = np.lexsort((self.first, three, two, one))
        one, two, three = one[order], two[order], three[order]
        same = (one[1:] == one[:-1]) & (two[1:] == two[:-1]) & (three[1:] == three[:-1])
        twin, lead = np.zeros(len(order), bool), np.ones(len(order), bool)
        twin[order] = np.r_[same, False] | np.r_[False, same]
        lead[order[1:]] = ~same
        return twin, lead

    def split(self, reach: int) -> "Units":
        """Units of ``reach`` windows at most, by their distance from the anchor; each has an anchor of its own, so many windows before."""
        low, high = (self.at - self.last) // reach, (self.at - self.first) // reach
        times = high - low + 1
        of = np.repeat(np.arange(len(times)), times)
        part = np.arange(len(of)) - np.repeat(np.cumsum(times) - times - low, times)
        at = self.at[of] - part * reach
        return Units(self.hashes, self.width, reach, at, np.maximum(self.first[of], at - reach + 1), np.minimum(self.last[of], at))


def pieces(column, width: int):
    """(first row, bytes, offsets, place of the bytes in the text) of slices; a long text comes in pieces that share ``width - 1`` bytes."""
    for i, _, data, off in slices(column):
        if len(data) <= PIECE + width:
            yield i, data, off, 0
        else:
            for k in range(0, len(data) - width + 1, PIECE):
                part = data[k : k + PIECE + width - 1]
                yield i, part, np.array([0, len(part)]), k


class Levels:
    """How far leading tokens are lengthened."""

    def __init__(self, width: int, reaches: list[int], repeats: list[Repeats]):
        self.width, self.reaches, self.repeats = width, reaches, repeats

    def deepest(self, units: Units) -> Units:
        """The units at the level that comes after those counted so far, one of each text."""
        for seen, reach in zip(self.repeats, self.reaches[1:], strict=False):
            units = units.where(units.twins()[1])
            units = units.where(seen.is_heavy(units.tokens())).split(reach)
        return units.where(units.twins()[1])

    def ways(self, units: Units):
        """(level, units, whether they travel): those that don't have been found to be repeated where they are."""
        for level, seen in enumerate(self.repeats):
            twin, lead = units.twins()
            yield level, units.where(twin), False
            units = units.where(lead)
            tokens = units.tokens()
            heavy = seen.is_heavy(tokens) if level + 1 < len(self.repeats) else np.zeros(len(tokens), bool)
            yield level, units.where(seen.may_repeat(tokens) & ~heavy), True
            if not heavy.any():
                return
            units = units.where(heavy).split(self.reaches[level + 1])


def _count(texts: DataFrame, width: int, reaches: list[int], heavy_from: int) -> Levels:
    levels = Levels(width, reaches, [])
    for _ in reaches:
        shared = texts.sparkSession.sparkContext.broadcast(levels)

        def tokens(batch, shared=shared):
            for _, data, off, _ in pieces(batch.column("text"), width):
                yield shared.value.deepest(Units.anchored(data, off, width, reaches[0])).tokens()

        seen = count_repeats(texts, tokens, bits=1 << (25 if levels.repeats else 27), heavy_from=heavy_from)
        levels = Levels(width, reaches, [*levels.repeats, seen])
        if not len(seen.heavy):
            break
    return levels


def multikey_quicksort(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings data[start : start + length], and the bytes that neighbours in it share.

    Eight bytes are one character.  All groups of strings that are equal up to a depth are
    sorted by their next character at once; those that stay tied go on.  Strings that end are
    as if zeros followed, the shorter of equals first.
    """
    n = len(start)
    order, common = np.arange(n), np.zeros(max(0, n - 1), np.int64)
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(TOKEN, np.uint8)]), TOKEN)
    place, group, depth = np.arange(n), np.zeros(n, np.int64), 0
    longest = int(length.max()) if n else 0
    while len(place) > 1 and depth < longest:
        i = order[place]
        character = views[np.minimum(start[i] + depth, len(data))].copy().view(">u8").ravel().astype(np.uint64) & MASKS[np.clip(length[i] - depth, 0, TOKEN)]
        k = np.lexsort((character, group))
        i, character = i[k], character[k]
        order[place] = i
        near = group[1:] == group[:-1]
        other = character[1:] ^ character[:-1]
        ends = near & (other > 0)
        common[place[:-1][ends]] = depth + np.argmax(other[ends].astype(">u8").view(np.uint8).reshape(-1, TOKEN) > 0, axis=1)
        tied = near & (other == 0)
        run = np.cumsum(np.r_[True, ~tied])
        stays = np.r_[tied, False] | np.r_[False, tied]
        place, group, depth = place[stays], run[stays], depth + TOKEN
    if len(place) > 1:
        i = order[place]
        order[place] = i[np.lexsort((length[i], group))]
        common[place[:-1][group[1:] == group[:-1]]] = longest
    size = length[order]
    return order, np.minimum(common, np.minimum(size[:-1], size[1:]))


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Numbers that are equal for strings with ``depth`` bytes in common."""
    out = np.zeros(len(order), np.int64)
    out[order[1:]] = np.cumsum(common < depth)
    return out


def repeated_windows(data: np.ndarray, off: np.ndarray, left: np.ndarray, width: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest distance before the anchor of a unit's windows that another unit has, too; reach and -1 where there is none."""
    n = len(left)
    low, high = np.full(n, reach), np.full(n, -1)
    if n < 2:
        return low, high
    size = np.diff(off)
    nearest = width + left - size
    after = multikey_quicksort(data, off[:-1] + left, size - left)
    lead = _classes(*after, width - reach + 1)
    some = np.bincount(lead)[lead] > 1
    if not some.all():
        at = np.flatnonzero(some)
        if len(at):
            part = np.concatenate([[0], np.cumsum(size[at])])
            place = np.repeat(off[:-1][at] - part[:-1], size[at]) + np.arange(part[-1])
            low[at], high[at] = repeated_windows(data[place], part, left[at], width, reach)
        return low, high
    before = multikey_quicksort(data[::-1], len(data) - off[:-1] - left, left)
    for a in range(reach):
        here = np.flatnonzero((nearest <= a) & (a <= left))
        if len(here) < 2:
            continue
        both = (_classes(*after, width - a)[here] << 32) | _classes(*before, a)[here]
        k = np.argsort(both, kind="stable")
        same = both[k][1:] == both[k][:-1]
        hit = here[k[np.r_[same, False] | np.r_[False, same]]]
        low[hit], high[hit] = np.minimum(low[hit], a), a
    return low, high


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, reach: int = REACH, heavy_from: int = HEAVY, bucket: int = BUCKET) -> DataFrame:
    """one, two (hashes that name id and text), start, end: bytes covered by repeated strings.  Spans may overlap.

    bucket: bytes of text that one task sorts; heavy_from: leading tokens of more units than this
    (and than 2**-20 of all) are lengthened.
    """
    if width < TOKEN:
        raise ValueError(f"width must be {TOKEN} at least")
    reach = max(1, min(reach, width - TOKEN + 1))
    reaches = sorted({reach, max(1, -(-reach // PARTS)), 1}, reverse=True)
    rows = docs.select(*keys(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text")).where(F.octet_length("text") >= width)
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    shared = spark.sparkContext.broadcast(_count(rows.select("text"), width, reaches, heavy_from))

    def units(batches):
        for batch in batches:
            one, two = batch.column("one").to_numpy(), batch.column("two").to_numpy()
            for i, data, off, base in pieces(batch.column("text"), width):
                raw = data.tobytes()
                for level, u, travels in shared.value.ways(Units.anchored(data, off, width, reach)):
                    if not len(u.at):
                        continue
                    d = np.searchsorted(off, u.first, "right") - 1
                    end = u.last + width
                    text = [raw[a:b] for a, b in zip(u.first.tolist(), end.tolist(), strict=True)] if travels else [None] * len(end)
                    place = u.first - off[d] + base
                    salt = signed(mix(one[i + d].astype(np.uint64) + place.astype(np.uint64))) if u.reach == 1 else np.zeros(len(d), np.int64)
                    columns = np.full(len(d), level, np.int32), salt, one[i + d], two[i + d], place, (u.at - u.first).astype(np.int32), (end - u.first).astype(np.int32)
                    yield pa.record_batch([*map(pa.array, columns), pa.array(text, pa.binary())], ["level", "salt", "one", "two", "first", "left", "size", "text"])

    sent = Observation()
    table, _ = write(rows.mapInArrow(units, UNITS).observe(sent, F.sum(F.octet_length("text")).alias("bytes")))
    buckets = max(parts, -(-(sent.get["bytes"] or 0) // bucket))
    levels = [r for r, _ in zip(reaches, shared.value.repeats, strict=False)]

    def sort(batches):
        batches = list(batches)
        if not batches:
            return
        held = pa.Table.from_batches(batches)
        number = TaskContext.get().partitionId()
        for level, reach_ in enumerate(levels):
            own = held.filter(pc.equal(held.column("level"), level)).combine_chunks()
            if not own.num_rows:
                continue
            one, two, first, left = (own.column(c).to_numpy() for c in ("one", "two", "first", "left"))
            text = pa.concat_arrays(own.column("text").cast(pa.large_binary()).chunks)
            off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2], np.uint8)[off[0] : off[-1]]
            off = off - off[0]
            low, high = repeated_windows(data, off, left.astype(np.int64), width, reach_)
            hit = np.flatnonzero(high >= 0)
            yield _rows(one[hit], two[hit], first[hit] + left[hit] - high[hit], first[hit] + left[hit] - low[hit] + width)
            if reach_ == 1:
                order, _ = multikey_quicksort(data, off[:-1], np.diff(off))
                ends = order[[0, -1]]
                yield _rows(one[ends], two[ends], first[ends], first[ends] + width, number, ["first", "last"], [data[off[k] : off[k + 1]].tobytes() for k in ends.tolist()])

    travels = table.where("text is not null")
    leading = [F.expr(f"substring(text, left + 1, {width + 1} - {_reach_sql(levels)})"), F.col("salt")]
    dealt = travels.repartitionByRange(buckets, F.col("level"), *leading).select("level", "one", "two", "first", "left", "text")
    found = dealt.mapInArrow(sort, EDGES)
    home = table.where("text is null").select("one", "two", F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("end"))
    if len(levels) < len(reaches):
        return home.unionByName(found.select("one", "two", "start", "end"))
    found = written(found)
    return home.unionByName(found.where("edge is null").select("one", "two", "start", "end")).unionByName(across_boundaries(found.where("edge is not null")))


def across_boundaries(edges: DataFrame) -> DataFrame:
    """Spans of the first and last windows of neighbouring buckets that are equal.  A bucket has two rows, so the window below holds two rows for each."""
    w = Window.orderBy("bucket", F.col("edge") == "last")
    last, first = F.col("edge") == "last", F.col("edge") == "first"
    next_, before = F.lead("window").over(w), F.lag("window").over(w)
    same = edges.withColumn("_met", (last & (F.col("window") == next_)) | (first & (F.col("window") == before)))
    return same.where("_met").select("one", "two", "start", "end")


def _reach_sql(levels: list[int]) -> str:
    return "case level " + " ".join(f"when {k} then {r}" for k, r in enumerate(levels)) + " end"


def _rows(one, two, start, end, bucket=None, edge=None, window=None):
    n = len(one)
    columns = [pa.array(one), pa.array(two), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64)), pa.array([bucket] * n, pa.int32()), pa.array(edge or [None] * n, pa.string()), pa.array(window or [None] * n, pa.binary())]
    return pa.record_batch(columns, ["one", "two", "start", "end", "bucket", "edge", "window"])


def keys(id_, text):
    """Two hashes that name an id and its text."""
    return F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), id_, text).alias("two")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, **tuning) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal runs of removed bytes) and kept (the bytes left, as binary: a cut may part a character)."""
    spans = repeated_spans(docs, id_col, text_col, width, **tuning)
    per = spans.groupBy("one", "two").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    row = row_of(c for c in docs.columns if c not in ADDED)
    left = docs.select(row, *keys(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
    both = left.join(per, ["one", "two"], "left").select("row", "text", "starts", "ends")

    def cut(batches):
        for batch in batches:
            starts, ends = batch.column("starts"), batch.column("ends")
            for i, j, data, off in slices(batch.column("text")):
                steps, raw = np.zeros(len(data) + 1, np.int32), data.tobytes()
                touched = [r for r in range(i, j) if starts[r].is_valid]
                for r in touched:
                    np.add.at(steps, off[r - i] + starts[r].values.to_numpy(), 1)
                    np.add.at(steps, off[r - i] + ends[r].values.to_numpy(), -1)
                gone = np.cumsum(steps[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = off[:-1][off[:-1] < len(data)]
                begins[inner] = gone[inner]
                removed, runs = (np.diff(np.r_[0, np.cumsum(x, dtype=np.int64)][off]) for x in (gone, begins))
                kept = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                for r in touched:
                    a, b = off[r - i], off[r - i + 1]
                    kept[r - i] = data[a:b][~gone[a:b]].tobytes()
                yield pa.record_batch([batch.column("row").slice(i, j - i), pa.array(np.diff(off)), pa.array(removed), pa.array(runs), pa.array(kept, pa.binary())], ["row", *ADDED])

    schema = StructType().add("row", both.schema["row"].dataType).add("n_bytes", LongType()).add("n_removed", LongType()).add("n_spans", LongType()).add("kept", BinaryType())
    return both.mapInArrow(cut, schema).select("row.*", *ADDED)


__all__ = ["repeated_spans", "drop_repeats", "multikey_quicksort", "repeated_windows", "across_boundaries"]
