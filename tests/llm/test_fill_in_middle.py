"""Fill-in-the-middle against plain slicing, and its wavelet matrix against counting."""

import hashlib
import re

import numpy as np
import pytest

from tallyspark.llm import fill_in_middle as fim

TEXTS = ["", None, "a", "one two\nthree", "é ß\tñ 漢字 🙂\n\n x", "<P> in it", "a <S", "<M", "S> < M>", "\n\n\n", " lead", "tail \n", "w " * 4000, "漢" * 3000, "\0\0 a"]


def by_hand(i, text, unit="char"):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)] if i is not None else [0, 0, 99, 0]
    ends = {"char": range(len(text) + 1), "word": [m.start() for m in re.finditer(r"(?<![^ \t-\r])[^ \t-\r]", text)] + [len(text)], "line": [0] + [m.end() for m in re.finditer("\n", text)]}[unit]
    n = len(ends) - 1
    a, b = sorted((ends[h[0] % (n + 1)], ends[h[1] % (n + 1)]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text, text
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return i, n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_parts_are_those_of_plain_slicing(spark, unit):
    rows = [(i, t) for i, t in enumerate(TEXTS * 6)] + [(None, "no id"), (3, TEXTS[3]), (3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fim.transform(docs, unit=unit).select("doc_id", *fim.ADDED).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((by_hand(i, t, unit) for i, t in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", 5, "k")], "doc_id long, text string, n int, `a.b` string").withColumnRenamed("n", "form")
    (row,) = fim.transform(docs).collect()
    assert row["a.b"] == "k" and row["form"] in ("plain", "psm", "spm") and row["restored"] == "some text"
    assert fim.transform(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fim.transform(docs, unit="page")
    with pytest.raises(ValueError):
        fim.transform(docs, marks=("<P>", "<P>", "<M>"))


def test_restore_finds_markers_across_any_seam():
    for p in ("", "<", "<P", "<S", "P>", "<<"):
        for m in ("", "S>", ">", "<M"):
            for s in ("", "M>", "<", "P>"):
                for form in ("psm", "spm"):
                    text = p + m + s
                    if not any(x in text for x in ("<P>", "<S>", "<M>")):
                        out = fim.arrange(p.encode(), m.encode(), s.encode(), form, (b"<P>", b"<S>", b"<M>"))
                        assert fim.restore(out, form) == text.encode()


def test_wavelet_matrix():
    r = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 65, 1000):
        s = r.integers(0, 5, n).astype(np.uint8)
        w = fim.WaveletMatrix(s)
        at = np.arange(n + 1)
        for c in range(5):
            assert w.rank(c, at).tolist() == np.r_[0, np.cumsum(s == c)].tolist()
            places = np.flatnonzero(s == c)
            if len(places):
                assert w.select(c, np.arange(len(places))).tolist() == places.tolist()
        either = np.flatnonzero((s == 1) | (s == 3))
        k = np.arange(len(either) + 1)
        assert w.locate((1, 3), k, np.zeros(len(k), np.int64), np.full(len(k), n)).tolist() == [*either.tolist(), n]
