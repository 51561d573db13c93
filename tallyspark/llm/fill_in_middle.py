"""Fill-in-the-middle transformation with cuts found in a wavelet matrix over character classes.

Every byte of a text has a class: it continues a character, or starts one that is white space, ends a
line, starts a word or goes on with one.  The classes of a slice of texts are kept as a wavelet matrix:
one bit vector for each bit of a class, the zeros of a level before its ones on the next, with
counts of ones before each word of 64 bits.  ``rank`` counts a class before a place by one step down
a level; ``select`` finds the place of the k-th of a class by the way back up.

Units of a cut are boundaries that ranks add up to: characters (all classes but the
continuing one), words (starts of words), or lines (ends of lines).  Boundaries of one class are
located by select; those of several by bisection on the sum of their ranks.  All texts of a slice
are asked at once.

The middle lies between two cuts drawn from a hash of seed and id.  psm puts the middle last, spm the
suffix first.  Texts that hold a marker, empty texts and a share of the others stay plain.  ``restore``
gives the text back from output and form alone: no text that holds a marker is ever cut, and a
marker's first byte occurs in it once, so none arises across a seam.

A null text is empty and plain, a null id plain.  Very long texts are a slice of their own, whose
matrix takes a few bytes a byte.  Cuts may be equal, at the start or at the end: parts are
then empty.  Repeated rows get equal results.  An empty table gives an empty one.  Other
columns pass through, whatever their names, but for those added, which are replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .shared import row_of
from .textblocks import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of bytes.  Those from SPACE on start a character.
CONTINUES, SPACE, LINE_END, WORD_START, WORD_INNER = range(5)
UNITS = {"char": (SPACE, LINE_END, WORD_START, WORD_INNER), "word": (WORD_START,), "line": (LINE_END,)}
ADDED = {"n": LongType(), "form": StringType(), "prefix_chars": LongType(), "middle_chars": LongType(), "output": StringType(), "restored": StringType()}
_BYTES = np.full(256, WORD_INNER, np.uint8)
_BYTES[[9, 11, 12, 13, 32]] = SPACE
_BYTES[10] = LINE_END
_BYTES[0x80:0xC0] = CONTINUES


def classes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The class of every byte of a slice of texts."""
    c = _BYTES[data]
    white = (c == SPACE) | (c == LINE_END)
    after = np.r_[True, white[:-1]] if len(c) else white
    after[off[:-1][off[:-1] < len(c)]] = True
    c[(c == WORD_INNER) & after] = WORD_START
    return c


class Bits:
    """A bit vector with the number of ones before each word of 64 bits."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        word, low = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th one or zero, from 0, by bisection on the counts and then on the ranks in a word."""
        counts = self.before if bit else np.arange(len(self.before)) * 64 - self.before
        word = np.searchsorted(counts, k, "right") - 1
        low, width = word * 64, 32
        while width:
            there = self.rank(low + width)
            low = np.where((there if bit else low + width - there) <= k, low + width, low)
            width //= 2
        return low


class WaveletMatrix:
    """Ranks and places of the classes of a sequence."""

    def __init__(self, symbols: np.ndarray, depth: int = 3):
        self.n, self.depth, self.levels, self.zeros = len(symbols), depth, [], []
        for level in range(depth):
            bits = (symbols >> (depth - 1 - level)) & 1
            self.levels.append(Bits(bits.astype(bool)))
            self.zeros.append(self.n - self.levels[-1].ones)
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def _bits(self, symbol: int):
        return [(symbol >> (self.depth - 1 - level)) & 1 for level in range(self.depth)]

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """How many of the symbol are before i."""
        start = np.zeros(1, np.int64)
        for bit, b, zeros in zip(self._bits(symbol), self.levels, self.zeros, strict=True):
            ones, first = b.rank(i), b.rank(start)
            i, start = (zeros + ones, zeros + first) if bit else (i - ones, start - first)
        return i - start

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th of the symbol, from 0; there must be one."""
        bits, start = self._bits(symbol), np.zeros(1, np.int64)
        for bit, b, zeros in zip(bits, self.levels, self.zeros, strict=True):
            first = b.rank(start)
            start = zeros + first if bit else start - first
        i = start + k
        for bit, b, zeros in zip(reversed(bits), reversed(self.levels), reversed(self.zeros), strict=True):
            i = b.select(i - zeros, 1) if bit else b.select(i, 0)
        return i

    def boundaries(self, symbols: tuple[int, ...], i: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, i) for s in symbols)

    def locate(self, symbols: tuple[int, ...], k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of boundary k, from 0 and counted over the whole sequence, in low..high; high where there is none before it."""
        there = k < self.boundaries(symbols, high)
        if len(symbols) == 1:
            return np.where(there, self.select(symbols[0], np.where(there, k, 0)) if there.any() else high, high)
        while (low < high).any():
            middle = (low + high) >> 1
            more = self.boundaries(symbols, middle + 1) > k
            low, high = np.where(more | (low >= high), low, middle + 1), np.where(more & (low < high), middle, high)
        return low


def cut(data: np.ndarray, off: np.ndarray, draws: np.ndarray, unit: str = "char"):
    """Units and characters of every text of a slice, and the bytes and characters before its cuts: draws (two rows) are taken modulo units + 1."""
    matrix = WaveletMatrix(classes(data, off))
    units, letters = UNITS[unit], UNITS["char"]
    base, end = off[:-1], off[1:]
    before = matrix.boundaries(units, base)
    n = matrix.boundaries(units, end) - before
    ranks = np.sort(draws % (n + 1).astype(np.uint64), axis=0).astype(np.int64)
    if unit == "line":  # a line goes with its end
        at = [np.where(r > 0, matrix.locate(units, before + np.maximum(r - 1, 0), base, end) + 1, base) for r in ranks]
    else:
        at = [matrix.locate(units, before + r, base, end) for r in ranks]
    first = matrix.boundaries(letters, base)
    return n, matrix.boundaries(letters, end) - first, [a - base for a in at], [matrix.boundaries(letters, a) - first for a in at]


def arrange(prefix: bytes, middle: bytes, suffix: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    p, s, m = marks
    return s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle


def restore(output: bytes, form: str, marks: tuple[bytes, bytes, bytes] = (b"<P>", b"<S>", b"<M>")) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return output
    p, s, m = marks
    (one, two), rest = ((s, p) if form == "spm" else (p, s)), output
    a, b = rest.index(two, len(one)), rest.index(m)
    first, second, middle = rest[len(one) : a], rest[a + len(two) : b], rest[b + len(m) :]
    return second + middle + first if form == "spm" else first + middle + second


def drawn(id_: F.Column, seed: int, k: int):
    """The k-th (from 1) eight hex digits of the SHA-256 of seed and id, as a number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256), 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1, plain_from: int = 90, spm_below: int = 20, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """docs with n (units of the text), form, prefix_chars and middle_chars (null if plain), output and restored.

    A text is plain where its third draw, of 100, is plain_from or more; of the others, the fourth below spm_below makes it spm, else psm.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    if len({m[:1] for m in marks} | {m[1:] for m in marks}) != 4 or any(m.count(m[0]) > 1 for m in marks):
        raise ValueError("markers must differ after a first character that they share and have once")
    id_, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    marked = F.lit(False)
    for m in marks:
        marked = marked | text.contains(m)
    plain = (text == "") | marked | F.coalesce(drawn(id_, seed, 3) % 100 >= plain_from, F.lit(True))
    form = F.when(plain, "plain").when(drawn(id_, seed, 4) % 100 < spm_below, "spm").otherwise("psm")
    row = row_of(c for c in docs.columns if c not in ADDED)
    rows = docs.select(row, text.alias("text"), form.alias("form"), *(F.coalesce(drawn(id_, seed, k), F.lit(0)).alias(f"draw{k}") for k in (1, 2)))
    raw_marks = tuple(m.encode() for m in marks)

    def work(batches):
        for batch in batches:
            forms = batch.column("form").to_pylist()
            draws = np.stack([batch.column(f"draw{k}").to_numpy() for k in (1, 2)]).astype(np.uint64)
            for i, j, data, off in slices(batch.column("text")):
                n, _, at, letters = cut(data, off, draws[:, i:j], unit)
                raw, out, back = data.tobytes(), [], []
                for d, (a, b, end) in enumerate(zip((off[:-1] + at[0]).tolist(), (off[:-1] + at[1]).tolist(), off[1:].tolist(), strict=True)):
                    form, start = forms[i + d], int(off[d])
                    out.append(raw[start:end] if form == "plain" else arrange(raw[start:a], raw[a:b], raw[b:end], form, raw_marks))
                    back.append(restore(out[-1], form, raw_marks))
                none = np.array([f == "plain" for f in forms[i:j]])
                columns = [pa.array(n), pa.array(forms[i:j]), pa.array(letters[0], mask=none), pa.array(letters[1] - letters[0], mask=none), *(pa.array(x, pa.binary()).cast(pa.string()) for x in (out, back))]
                yield pa.record_batch([batch.column("row").slice(i, j - i), *columns], ["row", *ADDED])

    schema = StructType().add("row", rows.schema["row"].dataType)
    for name, kind in ADDED.items():
        schema.add(name, kind)
    return rows.mapInArrow(work, schema).select("row.*", *ADDED)


__all__ = ["transform", "restore", "WaveletMatrix", "cut"]
