"""Substring dedup by prefix-partitioned suffix trees.

Every window of ``width`` words has an anchor: the leftmost smallest hash among its first
``REACH`` runs of ``PREFIX`` words.  Equal windows have equal anchors at the same place, so the
suffixes of the corpus are split by the words at their anchor, which is the prefix that
partitions the trees.  Anchors that occur once in the corpus start no repeat and are left out.

Prefixes have variable lengths.  One with more suffixes than a group may hold is lengthened
step by step, as far as all its windows reach beyond the anchor (``steps``); longer prefixes that
occur once are left out in turn.  One that is still too large is lengthened to the whole window.
Then its node is the prefix itself, and a partially aggregated minimum stands for the tree,
however many documents share it.

Suffixes are shipped as blocks of text, each with a terminator of its own.  Blocks of equal words
in one slice meet there (as do equal whole windows): only those of the smallest document travel
with their words, the others are covered by it and travel as spans.  A group's tree is a suffix array by prefix doubling with
the common lengths of neighbours: its intervals of ``width`` words and more are the deep internal
nodes, and those preceded by different words are maximal repeats.  Of each, the documents but the
smallest lose their words.  A group is solved in memory-sized runs of prefixes, cut within a
prefix where its words go on differently.

Nulls: a null text has no words, and a null id neither loses words nor makes others lose any.
Rows that repeat both id and text get the same result; texts under one id do not repeat each other.
An empty table gives an empty one.  Very long texts are read whole, a slice each; ties of hashes
go to the leftmost run, which is the same in equal windows.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Repeats, count_repeats
from .shared import partitions, row_of
from .textblocks import U, Words, grams, leftmost_minimum, mix, powers, signed, slices

PREFIX, REACH, GROUP, HEAVY = 8, 30, 8_000, 20_000
SPANS = "doc long, key long, start int, end int"


def steps(width: int, prefix: int, reach: int) -> list[int]:
    """Lengths of prefixes beyond the first that every window of an anchor holds."""
    top = width - reach + 1
    return sorted({(prefix + top) // 2, top} - set(range(prefix + 1)))


class Blocks:
    """Runs of windows with one anchor in a slice: first window, number of windows, place of the anchor, and its hash."""

    def __init__(self, data, off, width: int, prefix: int, reach: int):
        self.w = w = Words(data, off)
        self.h = h = w.hashes()
        self.start = self.count = self.at = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        m = len(h) - width + 1
        if m <= 0:
            return
        g, _ = grams(h, w.doc, prefix)
        anchor = leftmost_minimum(g, reach)[:m]
        valid = w.doc[:m] == w.doc[width - 1 :]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (w.doc[1:m] != w.doc[: m - 1])]
        self.start = np.flatnonzero(new & valid)
        self.count = np.flatnonzero(np.r_[new[1:] | ~valid[1:], True] & valid) + 1 - self.start
        self.at = anchor[self.start]
        self.anchor = g[self.at]

    def keep(self, which: np.ndarray) -> None:
        self.start, self.count, self.at, self.anchor = (x[which] for x in (self.start, self.count, self.at, self.anchor))

    def longer(self, length: int) -> np.ndarray:
        """Hashes of the ``length`` words from each anchor on."""
        return grams(self.h, self.w.doc, length)[0][self.at] if len(self.at) else np.zeros(0, np.uint64)

    def run_hashes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of all words of each block."""
        up, down = powers(len(self.h) + 1)
        end, both = self.start + self.count + width - 1, []
        for h in (self.h, mix(self.h ^ U(0x5851F42D4C957F2D))):
            c = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * up[: len(h)], out=c[1:])
            both.append(mix((c[end] - c[self.start]) * down[self.start] + (end - self.start).astype(np.uint64)))
        return both[0], both[1]


def _covered_here(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same two hashes."""
    order = np.lexsort((doc, two, one))
    a, b, d = one[order], two[order], doc[order]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    hit = np.zeros(len(doc), bool)
    hit[order] = d > np.repeat(d[new], np.diff(np.r_[new, len(d)]))
    return hit


class Lengths:
    """The prefix of each block: lengthened while it is heavy, None beyond the last step."""

    def __init__(self, first: Repeats, later: Repeats | None, lengths: list[int]):
        self.first, self.later, self.lengths = first, later, lengths

    def choose(self, b: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each block: hash of its prefix, whether that may repeat, and whether only the whole window is left."""
        prefix, repeats, heavy = b.anchor.copy(), self.first.may_repeat(b.anchor), self.first.is_heavy(b.anchor)
        for n in self.lengths if heavy.any() else []:
            more = b.longer(n)
            prefix[heavy] = more[heavy]
            repeats[heavy] = self.later.may_repeat(more[heavy])
            heavy &= self.later.is_heavy(more)
        return prefix, repeats, heavy


def _lengths(texts: DataFrame, width: int, prefix: int, reach: int, heavy_from: int) -> Lengths:
    lengths = steps(width, prefix, reach)

    def anchors(batch):
        for _, _, data, off in slices(batch.column("text")):
            yield Blocks(data, off, width, prefix, reach).anchor

    first = count_repeats(texts, anchors, heavy_from=heavy_from)
    if not len(first.heavy) or not lengths:
        return Lengths(first, None, [])
    shared = texts.sparkSession.sparkContext.broadcast(first)

    def longer(batch):
        for _, _, data, off in slices(batch.column("text")):
            b = Blocks(data, off, width, prefix, reach)
            b.keep(shared.value.is_heavy(b.anchor))
            for n in lengths:
                yield b.longer(n)

    return Lengths(first, count_repeats(texts, longer, bits=1 << 25, heavy_from=heavy_from), lengths)


def _names(blocks: Words):
    """Suffix ranks by prefix doubling over blocks with terminators: (place of each word, [(span, names of span words)], longest block)."""
    n, longest = blocks.docs, int(blocks.count.max())
    place = np.arange(len(blocks.start)) + blocks.doc
    top = 1 << (longest.bit_length() - 1)
    first = np.zeros(len(place) + n + 2 * top, np.uint64)
    first[place] = np.unique(blocks.hashes(), return_inverse=True)[1] + n
    first[blocks.first[1:] + np.arange(n)] = np.arange(n)
    levels = [(1, first.astype(np.uint32))]
    while (span := levels[-1][0]) < top:
        name = levels[-1][1].astype(np.uint64)
        levels.append((2 * span, np.unique((name[: len(name) - span] << U(32)) | name[span:], return_inverse=True)[1].astype(np.uint32)))
    return place, levels, longest


def maximal_repeats(common: np.ndarray, before: np.ndarray, doc: np.ndarray, depth: int):
    """The deep internal nodes that are maximal repeats: (depth, leaves, their nodes' smallest document), by depth.

    common: words shared by neighbours of sorted suffixes; before: the word before each, negative
    where it isn't known; leaves are places in that order.
    """
    leaf = np.arange(len(doc))
    while len(leaf):
        joined = common >= depth
        first = np.flatnonzero(np.r_[True, ~joined])
        size = np.diff(np.r_[first, len(leaf)])
        exact = np.minimum.reduceat(np.r_[np.where(joined, common, np.iinfo(np.int64).max), np.iinfo(np.int64).max], first) == depth
        low, high = np.minimum.reduceat(before, first), np.maximum.reduceat(before, first)
        node = np.repeat((size > 1) & exact & ((low != high) | (low < 0)), size)
        yield depth, leaf[node], np.repeat(np.minimum.reduceat(doc, first), size)[node]
        depth += 1
        joined = common >= depth
        left = np.r_[joined, False] | np.r_[False, joined]
        leaf, before, doc, common = leaf[left], before[left], doc[left], common[left[:-1]][: max(0, int(left.sum()) - 1)]


def _covered(doc, key, first, count, words, width):
    """Of blocks with whole groups of prefixes: runs of words in repeats of which a smaller document has a copy."""
    w = Words(np.frombuffer(b"".join(words), np.uint8), np.cumsum(np.r_[0, [len(t) for t in words]]))
    place, levels, longest = _names(w)
    block = np.repeat(np.arange(len(doc)), count)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    at = place[w.first[block] + nth]
    half, name = max(x for x in levels if x[0] <= width)
    _, same, times = np.unique((name[at].astype(np.uint64) << U(32)) | name[at + width - half], return_inverse=True, return_counts=True)
    deep = times[same] > 1
    block, nth, at = block[deep], nth[deep], at[deep]
    if not len(at):
        return None
    top, name = levels[-1]
    order = np.lexsort((name[at + longest - top], name[at]))
    block, nth, at = block[order], nth[order], at[order]
    common = np.zeros(len(at) - 1, np.int64)
    for span, name in reversed(levels):
        common += span * (name[at[:-1] + common] == name[at[1:] + common])
    before = np.where(nth > 0, levels[0][1][at - 1].astype(np.int64), -1)
    own, reach = doc[block], np.zeros(len(at), np.int64)
    for depth, leaf, least in maximal_repeats(common, before, own, width):
        reach[leaf[own[leaf] > least]] = depth
    return _runs(doc, key, first, block, nth, reach)


def _runs(doc, key, first, block, nth, reach):
    """Spans of words that overlap within a block, as one row."""
    hit = np.flatnonzero(reach)
    if not len(hit):
        return None
    hit = hit[np.lexsort((nth[hit], block[hit]))]
    block, start = block[hit], nth[hit]
    far = int((start + reach[hit]).max()) + 1
    end = np.maximum.accumulate(block * far + start + reach[hit])
    new = np.flatnonzero(np.r_[True, block[1:] * far + start[1:] > end[:-1]])
    b, last = block[new], np.r_[new[1:], len(block)] - 1
    return _spans(doc[b], key[b], first[b] + start[new], first[b] + end[last] - block[last] * far)


def _spans(doc, key, start, end):
    return pa.record_batch([pa.array(doc), pa.array(key), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc", "key", "start", "end"])


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, prefix: int = PREFIX, reach: int = REACH, group: int = GROUP, heavy_from: int = HEAVY
) -> DataFrame:
    """doc, key (hash of the text), start, end: runs of words covered by windows that also start in a document with a smaller id.  Runs may overlap.

    group: blocks solved together; heavy_from: a prefix of more blocks than this (and than 2**-20 of all) is lengthened.
    """
    if width < prefix + 1:
        raise ValueError("width must be above prefix")
    reach = max(1, min(reach, width - prefix + 1))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    lengths = _lengths(rows.select("text"), width, prefix, reach, heavy_from)
    shared = spark.sparkContext.broadcast(lengths)

    def blocks(batches):
        for batch in batches:
            docs_, keys = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
            for i, _, data, off in slices(batch.column("text")):
                b = Blocks(data, off, width, prefix, reach)
                at, repeats, whole = shared.value.choose(b)
                left = repeats & ~whole
                b.keep(left)
                at = at[left]
                if not len(at):
                    continue
                w, d = b.w, b.w.doc[b.start]
                doc, raw = docs_[i + d], data.tobytes()
                here = _covered_here(*b.run_hashes(width), doc)
                at[here] = mix(doc.astype(np.uint64) + b.start.astype(np.uint64))[here]  # spans only pass through: dealt evenly
                x, y = w.start[b.start].tolist(), w.end[b.start + b.count + width - 2].tolist()
                words = [None if gone else raw[s:e] for gone, s, e in zip(here.tolist(), x, y, strict=True)]
                columns = signed(at), signed(b.longer(width - reach + 1)), doc, keys[i + d], (b.start - w.first[d]).astype(np.int32), b.count.astype(np.int32)
                yield pa.record_batch([*map(pa.array, columns), pa.array(words, pa.binary())], ["prefix", "longer", "doc", "key", "first", "count", "words"])

    def trees(batches):
        held = None

        def cut(table):
            """The rows up to the last change of prefix, or else of the words that follow it, and the rest."""
            for c in ("prefix", "longer"):
                p = table.column(c).to_numpy()
                if len(other := np.flatnonzero(p != p[-1])):
                    return table.slice(0, int(other[-1]) + 1), table.slice(int(other[-1]) + 1)
            return table.slice(0, 0), table

        def solve(table):
            if table.num_rows > 1:
                out = _covered(*(table.column(c).to_numpy() for c in ("doc", "key", "first", "count")), table.column("words").to_pylist(), width)
                if out is not None:
                    yield out

        for batch in batches:
            here = pc.is_null(batch.column("words"))
            if len(gone := batch.filter(here)):
                first, count = gone.column("first").to_numpy(), gone.column("count").to_numpy()
                yield _spans(gone.column("doc").to_numpy(), gone.column("key").to_numpy(), first, first + count + width - 1)
            rest = pa.Table.from_batches([batch.filter(pc.invert(here))])
            held = pa.concat_tables([held, rest]) if held else rest
            if held.num_rows >= group:
                done, held = cut(held)
                yield from solve(done)
        if held:
            yield from solve(held)

    dealt = rows.mapInArrow(blocks, "prefix long, longer long, doc long, key long, first int, count int, words binary").repartition(parts, "prefix").sortWithinPartitions("prefix", "longer")
    spans = dealt.mapInArrow(trees, SPANS)
    if not len(lengths.first.heavy):
        return spans

    def windows(batches):
        for batch in batches:
            doc, key = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
            for i, _, data, off in slices(batch.column("text")):
                b = Blocks(data, off, width, prefix, reach)
                _, repeats, whole = shared.value.choose(b)
                b.keep(repeats & whole)
                if not len(b.start):
                    continue
                block = np.repeat(np.arange(len(b.start)), b.count)
                nth = np.arange(len(block)) - np.repeat(np.cumsum(b.count) - b.count, b.count)
                at = b.start[block] + nth
                one, two = grams(b.h, b.w.doc, width)[0][at], grams(mix(b.h ^ U(0x5851F42D4C957F2D)), b.w.doc, width)[0][at]
                d = b.w.doc[b.start]
                own, first = doc[i + d], b.start - b.w.first[d]
                here = _covered_here(one, two, own[block])
                gone = _runs(own, key[i + d], first, block, nth, here * width)
                left, begin = ~here, (first[block] + nth)[~here]
                open_ = _spans(own[block][left], key[i + d][block][left], begin, begin + width)
                for spans, one, two in ((open_, one[left], two[left]), (gone, None, None)):
                    if spans is not None:
                        if one is None:  # found here: dealt evenly, as no node is looked for
                            one = two = mix(spans.column("doc").to_numpy().astype(np.uint64) + spans.column("start").to_numpy().astype(np.uint64))
                        yield pa.record_batch([pa.array(signed(one)), pa.array(signed(two)), *spans.columns, pa.array(np.full(len(spans), spans is gone))], ["one", "two", "doc", "key", "start", "end", "found"])

    whole = rows.mapInArrow(windows, f"one long, two long, {SPANS}, found boolean")
    nodes = whole.where("not found").groupBy("one", "two").agg(F.min("doc").alias("least"))
    late = whole.join(nodes, ["one", "two"], "left").where("found or doc > least")
    return spans.unionByName(late.select("doc", "key", "start", "end"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, **tuning) -> DataFrame:
    """docs with n_words, n_removed and kept (the words left, joined by one space) beside their other columns, of which those named so are replaced."""
    spans = repeated_spans(docs, id_col, text_col, width, **tuning)
    span = F.struct("start", "end")
    per = spans.groupBy("doc", "key").agg(F.collect_list(span).alias("spans"))
    others = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    left = docs.select(row_of(others), F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    both = left.join(per, ["doc", "key"], "left").select("row", "text", F.expr("transform(spans, s -> s.start)").alias("starts"), F.expr("transform(spans, s -> s.end)").alias("ends"))

    def keep(batches):
        for batch in batches:
            starts, ends = batch.column("starts"), batch.column("ends")
            for i, j, data, off in slices(batch.column("text")):
                w = Words(data, off)
                gone = np.zeros(len(w.start) + 1, np.int64)
                for r in range(i, j):
                    if starts[r].is_valid:
                        np.add.at(gone, w.first[r - i] + np.array(starts[r].as_py()), 1)
                        np.add.at(gone, w.first[r - i] + np.array(ends[r].as_py()), -1)
                gone = np.cumsum(gone)[:-1] > 0
                raw = data.tobytes()
                removed = np.diff(np.r_[0, np.cumsum(gone)][w.first])
                kept = []
                for d in range(j - i):
                    s = slice(w.first[d], w.first[d + 1])
                    k = ~gone[s]
                    kept.append(b" ".join([raw[x:y] for x, y in zip(w.start[s][k].tolist(), w.end[s][k].tolist(), strict=True)]) if removed[d] else b" ".join(raw[off[d] : off[d + 1]].split()))
                yield pa.record_batch([batch.column("row").slice(i, j - i), pa.array(w.count), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "n_words", "n_removed", "kept"])

    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType().add("row", both.schema["row"].dataType).add("n_words", LongType()).add("n_removed", LongType()).add("kept", StringType())
    return both.mapInArrow(keep, schema).select("row.*", "n_words", "n_removed", "kept")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


__all__ = ["repeated_spans", "drop_repeats", "digest", "maximal_repeats"]
