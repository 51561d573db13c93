"""The suffix array against counts of all strings, on texts that repeat in awkward ways."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import suffix_array


def make_rows(seed):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(60)] + ["é", "ß9", "\0", "\0\0"]
    passage = " ".join(r.choice(words) for _ in range(150))
    rows = []
    for i in range(40):
        text = " ".join(r.choice(words) for _ in range(r.randrange(0, 120)))
        if i % 6 == 0:
            text += passage + text[:50]
        elif i % 6 == 1:
            text = passage[r.randrange(100) :][: r.randrange(150, 400)] + text
        elif i % 6 == 2:
            text = "a" * r.randrange(0, 700) + "abc" * r.randrange(0, 200)
        elif i % 6 == 3 and rows:
            text = rows[r.randrange(len(rows))][1] or ""
        elif i % 6 == 4:
            text = (passage[:260] + " x " + text)[: r.randrange(1, 900)]
        rows.append((i if i % 9 else None, text))
    return rows + [(100, None), (101, ""), (101, rows[0][1]), (101, rows[0][1]), (102, "\0" * 500), (103, "\0" * 300 + "b")]


def by_hand(rows, width):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + width] for _, b in raw for k in range(len(b) - width + 1))
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = True
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if b else 0
        yield i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("seed, width, tuning", [(0, 200, {}), (1, 200, {"heavy_from": 1, "bucket": 3000}), (2, 24, {"heavy_from": 2, "bucket": 500}), (3, 8, {"heavy_from": 2}), (4, 30, {"reach": 5, "heavy_from": 2})])
def test_removes_what_counts_say(spark, seed, width, tuning):
    """Heavy tokens in one case are split down to single windows, over several buckets."""
    rows = make_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = suffix_array.drop_repeats(docs, width=width, **tuning)
    got = left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(by_hand(rows, width), key=repr)


def test_long_texts_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_array, "PIECE", 700)
    rows = [(0, "".join(random.Random(5).choices("abcd", k=3000))), (1, "x" * 2500)]
    rows.append((2, "q" + rows[0][1][650:1900] + rows[1][1][:199]))
    pieces = list(suffix_array.pieces(spark.createDataFrame(rows, "i int, text string").toArrow().column("text").combine_chunks().slice(0, 1), 200))
    assert [(base, len(data)) for _, data, _, base in pieces] == [(0, 899), (700, 899), (1400, 899), (2100, 899), (2800, 200)]
    got = suffix_array.drop_repeats(spark.createDataFrame(rows, "doc_id int, text string")).select("doc_id", "n_removed").collect()
    assert {tuple(r) for r in got} == {(i, n) for i, _, n, *_ in by_hand(rows, 200)}


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "z" * 300, "k", 5)], "doc_id long, text string, `a.b` string, n_bytes int").withColumn("one", F.lit(9)).withColumn("kept", F.lit("old"))
    (row,) = suffix_array.drop_repeats(docs).collect()
    assert row.asDict() == {"doc_id": 1, "text": "z" * 300, "a.b": "k", "one": 9, "n_bytes": 300, "n_removed": 300, "n_spans": 1, "kept": bytearray()}
    assert suffix_array.drop_repeats(docs.limit(0)).collect() == []


def test_multikey_quicksort():
    r = random.Random(2)
    strings = [bytes(r.choices([0, 0, 1, 97], k=r.randrange(0, 40))) for _ in range(500)] + [b"", b"", b"a" * 70, b"a" * 71, b"a" * 70]
    size = np.array([len(s) for s in strings])
    order, common = suffix_array.multikey_quicksort(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size)
    assert [strings[i] for i in order] == sorted(strings)
    shared = [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(sorted(strings), sorted(strings)[1:], strict=False)]
    assert common.tolist() == shared


def test_equal_windows_meet_across_boundaries(spark):
    edges = [(0, "first", b"a"), (0, "last", b"c"), (1, "first", b"c"), (1, "last", b"c"), (3, "first", b"c"), (3, "last", b"d"), (4, "first", b"e"), (4, "last", b"e")]
    table = spark.createDataFrame([(k, 0, k, k + 1, *e) for k, e in enumerate(edges)], suffix_array.EDGES)
    assert sorted(r.one for r in suffix_array.across_boundaries(table).collect()) == [1, 2, 3, 4]
