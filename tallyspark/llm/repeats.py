"""Which 64-bit hashes occur more than once in a corpus, and about how often, counted in packed form.

Tasks deal their hashes into ranges and ship one packed block of 4-byte remainders for each
range, an eighth of what rows would take.  A hash that a block has ``OFTEN`` times or more is
shipped once, with its count, so one that every document has doesn't fill its range.  Each range
is counted on its own.  What comes back is bounded by parameters: a bitmap of ``bits`` bits, half
as many bits of count classes, and at most ``2**20`` heavy hashes.  The bitmap has no false
negatives, so a hash whose bit is clear occurs once in the corpus; a class is never below its
hash's own.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import partitions
from .textblocks import U

HEAVY_BITS = 20
FLUSH, OFTEN = 1 << 19, 4


@dataclass
class Repeats:
    ranges: int
    bitmap: np.ndarray
    classes: np.ndarray
    heavy: np.ndarray
    total: int

    def where(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((h >> U(32)) * U(self.ranges)) >> U(32), h & U(0xFFFFFFFF)

    def may_repeat(self, h: np.ndarray) -> np.ndarray:
        r, low = self.where(h)
        each = U(len(self.bitmap) * 8 // self.ranges)
        bit = r * each + ((low * each) >> U(32))
        return (self.bitmap[bit >> U(3)] >> (bit & U(7)).astype(np.uint8)) & 1 > 0

    def frequency_class(self, h: np.ndarray) -> np.ndarray:
        """0 for a hash that occurs once, else at least 1 + its count's binary logarithm from ``OFTEN`` on (1 below); the same for equal hashes."""
        r, low = self.where(h)
        each = U(len(self.classes) * 2 // self.ranges)
        at = r * each + ((low * each) >> U(32))
        log = (self.classes[at >> U(1)] >> ((at & U(1)) * U(4)).astype(np.uint8)) & 15
        return np.where(self.may_repeat(h), log + 1, 0)

    def is_heavy(self, h: np.ndarray) -> np.ndarray:
        if not len(self.heavy):
            return np.zeros(len(h), bool)
        r, low = self.where(h)
        key = (r << U(32)) | low
        return self.heavy[np.minimum(np.searchsorted(self.heavy, key), len(self.heavy) - 1)] == key


def count_repeats(docs: DataFrame, hashes: Callable, bits: int = 1 << 27, heavy_from: int = 5000) -> Repeats:
    """hashes: from an Arrow batch of docs to arrays of 64-bit hashes.  Heavy: more often than heavy_from, and than 2**-20 of all."""
    spark = docs.sparkSession
    parts = partitions(spark)
    ranges = 1 << max(8, (4 * parts - 1).bit_length())
    bits = max(bits, 64 * ranges)
    each, places = bits // ranges, bits // 8 // ranges

    def pack(batches):
        held, n = [], 0

        def flush():
            h = np.sort(np.concatenate(held))
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            times = np.diff(np.r_[new, len(h)])
            often = times >= OFTEN
            many, count = h[new[often]], times[often].astype(np.uint32)
            once = h[np.repeat(~often, times)]
            # sorted hashes are sorted by range
            edges = (np.arange(ranges + 1, dtype=object) * (1 << 64) // ranges)[1:-1].astype(np.uint64)
            a, b = np.r_[0, np.searchsorted(once, edges), len(once)], np.r_[0, np.searchsorted(many, edges), len(many)]
            full = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0))
            once, low = (once & U(0xFFFFFFFF)).astype(np.uint32), (many & U(0xFFFFFFFF)).astype(np.uint32)
            blocks = [once[a[r] : a[r + 1]].tobytes() for r in full]
            pairs = [np.concatenate([low[b[r] : b[r + 1]], count[b[r] : b[r + 1]]]).tobytes() for r in full]
            return pa.record_batch([pa.array(full.astype(np.int32)), pa.array(blocks, pa.binary()), pa.array(pairs, pa.binary())], ["range", "block", "often"])

        for batch in batches:
            for h in hashes(batch):
                if len(h):
                    held.append(h)
                    n += len(h)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def count(batches):
        at, held, pairs = None, [], []

        def result():
            low, weight = np.frombuffer(b"".join(held), np.uint32), np.concatenate([np.zeros(0, np.uint32), *(x.reshape(2, -1)[1] for x in pairs)])
            low = np.concatenate([low, *(x.reshape(2, -1)[0] for x in pairs)])
            weight = np.r_[np.ones(len(low) - len(weight), np.int64), weight.astype(np.int64)]
            order = np.argsort(low, kind="stable")
            low = low[order]
            new = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            low, n = low[new], np.add.reduceat(weight[order], new)
            flags, logs = np.zeros(each, np.uint8), np.zeros(places, np.uint8)
            flags[(low[n > 1].astype(np.uint64) * U(each)) >> U(32)] = 1
            some = n >= OFTEN
            np.maximum.at(logs, ((low[some].astype(np.uint64) * U(places)) >> U(32)).astype(np.int64), np.minimum(np.log2(n[some]), 15).astype(np.uint8))
            limit = max(heavy_from, (int(n.sum()) * ranges) >> HEAVY_BITS)
            heavy = (U(at) << U(32)) | low[n > limit].astype(np.uint64)
            return pa.record_batch(
                [pa.array([at], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary()), pa.array([(logs[::2] | (logs[1::2] << 4)).tobytes()], pa.binary()), pa.array([heavy.tobytes()], pa.binary()), pa.array([int(n.sum())], pa.int64())],
                ["range", "flags", "logs", "heavy", "total"],
            )

        for batch in batches:
            for r, block, often in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if r != at and at is not None:
                    yield result()
                    held, pairs = [], []
                at = r
                held.append(block.as_py())
                pairs.append(np.frombuffer(often.as_py(), np.uint32))
        if at is not None:
            yield result()

    dealt = docs.mapInArrow(pack, "range int, block binary, often binary").repartition(parts, "range").sortWithinPartitions("range")
    # a row for each range, of fixed size but for the heavy hashes, which are at most 2**20
    rows = dealt.mapInArrow(count, "range int, flags binary, logs binary, heavy binary, total long").collect()
    bitmap, classes = np.zeros(bits // 8, np.uint8), np.zeros(bits // 16, np.uint8)
    for row in rows:
        bitmap[row["range"] * each // 8 : (row["range"] + 1) * each // 8] = np.frombuffer(row["flags"], np.uint8)
        classes[row["range"] * places // 2 : (row["range"] + 1) * places // 2] = np.frombuffer(row["logs"], np.uint8)
    heavy = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["heavy"], np.uint64) for r in rows)]))
    return Repeats(ranges, bitmap, classes, heavy, sum(r["total"] for r in rows))
