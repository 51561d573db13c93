"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are folded (A-Z, any ASCII white space as a space) and compared as code points.  An item
of m characters may appear with up to e edits: ``rate`` of m, but few enough that by the q-gram
lemma half its q-grams survive them.  Then some stretch of 32 positions of the document has its
share of them; only around such stretches are the shared q-grams looked at, by item and
diagonal.  Diagonals form bands of 2(e + 1), each starting e + 1 after the one before, so the
diagonals of one appearance lie within one band.  Bands with m - q + 1 - q * e shared q-grams or
more are verified by an alignment that stays in the band, with free ends in the document.

The benchmark is taken in blocks of bounded size, each broadcast in turn, so it may be larger
than memory.  Null texts and items are empty.  An item of fewer than q characters has no q-gram:
it is found where it stands exactly and apart, with no letter or digit beside it, by the hash of all its characters.
An empty item and one with a null id match nothing.  Rows with null or repeated ids are
searched each on their own, and very long texts whole.  Of several bands that find one place the
one of fewest edits is kept.  Without documents or items nothing is found and nothing dropped.
Columns of documents beside id and text pass through ``drop_contaminated``, whatever their names.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import CHAIN, U, codepoints, mix, slices

Q, RATE, STRETCH, BLOCK = 8, 0.08, 32, 4_000_000
TABLE = 22
#: Pairs of a hit and an item that holds its q-gram, at a time: text of a template and many items of it meet in pieces.
ENTRIES = 1 << 19


def fold(points: np.ndarray) -> np.ndarray:
    upper = (points >= 65) & (points <= 90)
    white = ((points >= 9) & (points <= 13)) | (points == 32)
    return np.where(upper, points + 32, np.where(white, 32, points)).astype(np.uint32)


def qgrams(points: np.ndarray, q: int) -> np.ndarray:
    m = max(0, len(points) - q + 1)
    g = np.zeros(m, np.uint64)
    for k in range(q):
        g = g * CHAIN + points[k : k + m]
    return mix(g)


@dataclass
class Index:
    ids: np.ndarray
    items: list[np.ndarray]
    edits: np.ndarray
    needed: np.ndarray
    share: int
    longest: int
    table: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: "Short | None" = None


class Short:
    """Items of fewer than q characters by length, with the sorted hashes of their characters."""

    def __init__(self, ids, items: list[np.ndarray]):
        self.ids, self.items, self.by_length = ids, items, {}
        for m in sorted({len(x) for x in items}):
            own = np.array([k for k, x in enumerate(items) if len(x) == m])
            key = np.array([qgrams(items[k], m)[0] for k in own])
            order = np.argsort(key, kind="stable")
            self.by_length[m] = key[order], own[order]

    def regions(self, points: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, end, 0) of their appearances in a slice's documents; two items may be equal."""
        out = []
        inner = np.fromiter((chr(c).isalnum() for c in np.unique(points).tolist()), bool)
        word = inner[np.searchsorted(np.unique(points), points)] if len(points) else inner
        for m, (key, item) in self.by_length.items():
            g = qgrams(points, m)
            at = np.flatnonzero(np.isin(g, key))
            doc = np.searchsorted(off, at, "right") - 1
            ok = at + m <= off[doc + 1]
            ok &= (at == off[doc]) | ~word[np.maximum(at - 1, 0)]
            ok &= (at + m == off[doc + 1]) | ~word[np.minimum(at + m, len(points) - 1)]
            for a, d in zip(at[ok].tolist(), doc[ok].tolist(), strict=True):
                for k in item[np.searchsorted(key, g[a], "left") : np.searchsorted(key, g[a], "right")].tolist():
                    if (self.items[k] == points[a : a + m]).all():
                        out.append((d, k, a - int(off[d]), a - int(off[d]) + m, 0))
        return sorted(out)


def build(ids, texts, q: int = Q, rate: float = RATE) -> Index | None:
    """The q-gram index of a block of items."""
    items = [fold(np.frombuffer((t or "").encode("utf-32-le"), np.uint32)) for t in texts]
    few = [k for k, x in enumerate(items) if 0 < len(x) < q]
    short = Short(np.array([ids[k] for k in few]), [items[k] for k in few]) if few else None
    keep = [k for k, x in enumerate(items) if len(x) >= q]
    if not keep:
        none = np.zeros(0, np.int64)
        return Index(none, [], none, none, 1, 0, np.zeros(0, bool), none, none, none, none, short) if short else None
    ids, items = np.array([ids[k] for k in keep]), [items[k] for k in keep]
    m = np.array([len(x) for x in items])
    edits = np.minimum((rate * m).astype(int), (m - q) // (2 * q))
    needed = m - q + 1 - q * edits
    share = int((needed // -(-(m + edits) // STRETCH)).min())
    g = [qgrams(x, q) for x in items]
    key, item, place = np.concatenate(g), np.repeat(np.arange(len(items)), [len(x) for x in g]), np.concatenate([np.arange(len(x)) for x in g])
    order = np.argsort(key, kind="stable")
    key, item, place = key[order], item[order], place[order]
    keys, first = np.unique(key, return_index=True)
    table = np.zeros(1 << TABLE, bool)
    table[keys & U((1 << TABLE) - 1)] = True
    return Index(ids, items, edits, needed, max(1, share), int(m.max()), table, keys, np.r_[first, len(key)], item, place, short)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(edits, end) of the best place of the item in text with diagonals low to high; the earliest end of equals."""
    width, m = high - low + 1, len(item)
    padded = np.full(m + width, 0xFFFFFFFF, np.uint32)
    a, b = max(0, low), min(len(text), low + m + width)
    padded[a - low : max(a, b) - low] = text[a : max(a, b)]
    span = np.arange(width)
    row = np.zeros(width, np.int64)
    for i in range(m):
        step = row + (item[i] != padded[i : i + width])
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - span) + span
    k = int(row.argmin())
    return int(row[k]), m + low + k


def regions(index: Index, points: np.ndarray, off: np.ndarray, q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """(document, item, start, end, edits) of the appearances of items in a slice's documents."""
    g = qgrams(points, q)
    maybe = index.table[g & U((1 << TABLE) - 1)]
    at = np.flatnonzero(maybe)
    k = np.minimum(np.searchsorted(index.keys, g[at]), len(index.keys) - 1)
    doc = np.searchsorted(off, at, "right") - 1
    ok = (index.keys[k] == g[at]) & (at + q <= off[doc + 1])
    at, k, doc = at[ok], k[ok], doc[ok]
    if len(at) < index.share:
        return []
    # stretches that hold their share: the hit and the one share - 1 further lie within a stretch
    s = index.share
    dense = at[: len(at) - s + 1][at[s - 1 :] - at[: len(at) - s + 1] < STRETCH]
    if not len(dense):
        return []
    reach = np.zeros(len(points) + 1, np.int64)
    far = 2 * index.longest + STRETCH
    np.add.at(reach, np.maximum(dense - far, 0), 1)
    np.add.at(reach, np.minimum(dense + far, len(points)), -1)
    near = np.cumsum(reach)[at] > 0
    at, k, doc = at[near], k[near], doc[near]
    n = index.first[k + 1] - index.first[k]
    cuts = np.flatnonzero(np.diff(np.r_[-1, (np.cumsum(n) - 1) // ENTRIES])) if len(n) else n
    found = [_bands(index, at[c], k[c], n[c], doc[c], off) for c in map(slice, cuts, [*cuts[1:], len(n)])]
    doc, item, band, count = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:
        order = np.lexsort((band, item, doc))
        doc, item, band, count = doc[order], item[order], band[order], count[order]
        start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        # a place that two runs of hits have counts twice: no region is lost by that
        doc, item, band, count = doc[start], item[start], band[start], np.add.reduceat(count, start)
    out: dict[tuple, tuple] = {}
    for x in np.flatnonzero(count >= index.needed[item]):
        d, i, edits = int(doc[x]), int(item[x]), int(index.edits[item[x]])
        low = int(band[x]) * (edits + 1) - (1 << 40)
        _verify(index.items[i], points[off[d] : off[d + 1]], low, low + 2 * edits + 1, edits, d, i, out)
    return [(dd, ii, *v) for (dd, ii, _), v in sorted(out.items())]


def _bands(index: Index, at, k, n, doc, off):
    """(document, item, band, shared q-grams) of a run of hits, by all items that hold their q-grams."""
    entry = np.repeat(index.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
    at, doc = np.repeat(at, n), np.repeat(doc, n)
    item, place = index.item[entry], index.place[entry]
    # the band b starts at b * step and ends before (b + 2) * step, so a diagonal is in two
    band = (at - place - off[doc] + (1 << 40)) // (index.edits[item] + 1)
    band = np.r_[band, band - 1]
    doc, item, place = (np.r_[x, x] for x in (doc, item, place))
    order = np.lexsort((place, band, item, doc))
    doc, item, band, place = (x[order] for x in (doc, item, band, place))
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])]
    start = np.flatnonzero(new)
    return doc[start], item[start], band[start], np.add.reduceat((new | np.r_[True, place[1:] != place[:-1]]).astype(np.int64), start)


def _verify(item, text, low, high, most, dd, ii, out):
    edits, end = align(item, text, low, high)
    if edits <= most:
        if edits == 0:
            start = end - len(item)
        else:
            back, stop = align(item[::-1], text[:end][::-1], 0, min(most, max(0, end - 1)))
            start = end - stop if back <= edits else max(0, end - len(item))
        key = (dd, ii, start)
        if key not in out or out[key][2] > edits:
            out[key] = (start, end, edits)


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """doc, key (hash of the text), item, start, end, edits: appearances of benchmark items in documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    items = benchmark.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, found = max(1, -(-total // block)), []
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).orderBy("item", "text").collect()
        index = build([r[0] for r in part], [r[1] for r in part], q, rate)
        if index is not None:
            found.append(_search(rows, index, q))
    schema = "doc long, key long, item long, start int, end int, edits int"
    out = docs.sparkSession.createDataFrame([], schema) if not found else found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _search(rows: DataFrame, index: Index, q: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def search(batches):
        for batch in batches:
            doc, key = batch.column("doc"), batch.column("key")
            for i, _, data, off in slices(batch.column("text"), 512 << 10):
                points, at = codepoints(data, off)
                points, index = fold(points), shared.value
                found = [(index.ids, regions(index, points, at, q) if index.items else [])]
                found += [(index.short.ids, index.short.regions(points, at))] if index.short else []
                for ids, got in found:
                    if not got:
                        continue
                    d = pa.array([i + x[0] for x in got])
                    yield pa.record_batch([doc.take(d), key.take(d), pa.array(ids[[x[1] for x in got]]), *(pa.array([x[c] for x in got], pa.int32()) for c in (2, 3, 4))], ["doc", "key", "item", "start", "end", "edits"])

    return rows.mapInArrow(search, "doc long, key long, item long, start int, end int, edits int")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those in which a benchmark item appears."""
    hit = find_items(docs, benchmark, id_col, text_col, **options).select("doc", "key").distinct()
    return docs.join(hit, docs[id_col].cast("long").eqNullSafe(hit["doc"]) & (F.xxhash64(docs[text_col]) == hit["key"]), "left_anti")
