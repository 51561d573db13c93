"""Vectorised word and n-gram work on Arrow text columns.

Texts stay UTF-8 bytes.  A word is a maximal run of bytes other than space, tab, newline,
vertical tab, form feed and carriage return.  A null text has no words.  Work goes slice by
slice of ``SLICE`` bytes and ``ROWS`` rows at most, so a task's memory follows these (or its
longest document), not its partition, and neither very long nor very many tiny texts swell it.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE, ROWS = 512 << 10, 1024
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
STEP, CHAIN = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * STEP)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """STEP**i and its inverse modulo 2**64, for i up to n."""
    if len(_powers[0]) <= n:
        inverse = U(pow(int(STEP), -1, 1 << 64))
        for i, base in enumerate((STEP, inverse)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers


def slices(column: pa.Array, most: int = SLICE, rows: int = ROWS):
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``most`` bytes and at most ``rows`` rows."""
    for first in range(0, len(column), rows):
        part = pc.fill_null(column.slice(first, rows).cast(pa.large_string()), "")
        off = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        raw = part.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        i, n = 0, len(part)
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1))
            yield first + i, first + j, data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans data[start:end]."""
    up, down = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=c[1:])
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64))


def per_doc_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i + 1]]."""
    c = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


class Words:
    """Words of a slice: byte bounds, document number (within the slice) and 64-bit hash of each."""

    def __init__(self, data: np.ndarray, off: np.ndarray, fold: bool = False, white: np.ndarray = WHITE):
        self.data, self.off, self.docs = (LOWER[data] if fold else data), off, len(off) - 1
        inside = ~white[data]
        cut = np.unique(off[1:-1])
        cut = cut[(cut > 0) & (cut < len(data))]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.docs + 1))

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words, and whether they are words of one document, by first word."""
    m = max(0, len(h) - n + 1)
    g, width, power = h, 1, CHAIN
    with np.errstate(over="ignore"):
        while width * 2 <= n:
            g, width, power = g[: len(g) - width] * power + g[width:], width * 2, power * power
        if width < n:  # two overlapping halves name the n words as well as two adjoining ones
            g = g[:m] * CHAIN + mix(g[n - width : n - width + m])
    return mix(g[:m]), doc[:m] == doc[n - 1 :] if m else np.zeros(0, bool)


def leftmost_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of ``width`` consecutive hashes, the leftmost of equals, by first position."""
    m = max(0, len(h) - width + 1)
    at, span = np.arange(len(h)), 1

    def join(a, b):
        return np.where(h[b] < h[a], b, a)

    while span * 2 <= width:
        at, span = join(at[: len(at) - span], at[span:]), span * 2
    return join(at[:m], at[width - span : width - span + m]) if span < width else at[:m]


def per_document(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, key), sorted by both."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[keep], doc[keep]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def codepoints(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice, and the offsets of its documents in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return points, np.r_[0, np.cumsum((data & 0xC0) != 0x80)][off]
