"""Names with dots, short items, damaged archives, and hot hosts."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, jaccard_join, langid, line_dedup, substring_dedup, warc


@pytest.fixture(scope="module")
def dotted(spark):
    rows = [(i, f"{'abc'[i % 3]} " * 30 + f"\nline\nown {i}", "en" if i % 2 else "de", "s", i) for i in range(8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `a.b` int").withColumn("c`d", F.lit("x"))


def test_names_with_dots(dotted):
    assert {r["a.b"] for r in substring_dedup.drop_repeats(dotted, width=20).collect()} == set(range(8))
    assert {(r["a.b"], r["c`d"]) for r in line_dedup.drop_boilerplate(dotted).collect()} == {(i, "x") for i in range(8)}
    assert len(jaccard_join.one_of_each(dotted.unionByName(dotted.withColumn("text", F.upper("text"))), n=3).collect()) <= 8
    assert {r["a.b"] for r in langid.predict(dotted, langid.fit(dotted.select("lang", "text"))).collect()} == set(range(8))


def test_items_below_a_q_gram_are_found_where_they_stand_apart(spark):
    r = random.Random(8)
    items = [(1, "is 42"), (2, "7"), (3, "é!"), (4, ""), (5, None), (6, "IS 42"), (7, "a"), (8, "1234567"), (9, "a whole item of the benchmark, long enough")]
    docs = [(0, "the answer is 42 now"), (1, "this 42"), (2, "is 42"), (3, "x7 7x 7,7"), (4, "café! é! é!"), (5, ""), (6, None), (7, "A\ta"), (8, "1234567 12345678"), (9, "so: A whole item of the  benchmark, long enough.")]
    docs += [(10 + k, "".join(r.choices("a7 é!", k=40))) for k in range(20)]

    def apart(text, item):
        plain = lambda s: "".join(" " if c in "\t\n\x0b\x0c\r " else c.lower() if c < "\x80" else c for c in s)
        t, x = plain(text or ""), plain(item or "")
        return {k for k in range(len(t) - len(x) + 1) if x and t[k : k + len(x)] == x and not (k and t[k - 1].isalnum()) and not (k + len(x) < len(t) and t[k + len(x)].isalnum())}

    want = {(d, i, k, k + len(x)) for d, t in docs for i, x in items if x and len(x) < 8 for k in apart(t, x)}
    for block in (decontaminate.BLOCK, 10):
        got = decontaminate.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=block).collect()
        assert {(r.doc, r.item, r.start, r.end) for r in got if r.item != 9} == want and len(want) > 20
        assert {(r.doc, r.edits) for r in got if r.item == 9} == {(9, 1)}


def test_a_bad_record_is_an_error_among_good_ones(spark):
    good = [warc.member(warc.record(k, f"u{k}", b"payload %d" % k)) for k in range(4)]
    broken = bytearray(good[1])
    broken[len(broken) // 2] ^= 0xFF
    wrong = warc.member(warc.record(9, "u", b"payload").replace(b"payload", b"pAyload"))
    archive = good[0] + bytes(broken) + good[2] + b"\0" * 16 + wrong + good[3] + b"\0" * 16
    table = spark.createDataFrame([(archive,), (good[0] + good[1][:-9],), (b"",), (None,), (b"\0" * 9,)], "archive binary")
    rows = warc.read_archives(table).collect()
    assert sorted(r.page_id for r in rows if r.error is None) == [0, 0, 2, 3]
    bad = sorted((r.offset, r.error) for r in rows if r.error)
    assert [o for o, _ in bad] == sorted([len(good[0]), len(good[0]), len(good[0]) + len(broken) + len(good[2]) + 16]) and any("digest" in e for _, e in bad) and any("ends within" in e for _, e in bad)
    assert {r.payload for r in rows if r.error} == {None}
    with pytest.raises(Exception, match="digest|gzip|ends within"):  # whichever task fails first
        warc.read_archives(table, strict=True).collect()
    assert [r["payload"] for r in warc.records(good[0] + b"\0" * 5 + good[1])] == [b"payload 0", b"payload 1"]
    assert zlib.decompress(good[0], 31).startswith(b"WARC/1.0")


def test_lines_of_a_hot_host_meet_its_pages_by_salt(spark):
    r = random.Random(3)
    rows = [(i, f"h{i % 7}" if i % 3 else "hot", "\n".join(r.choice(["menu", "footer", f"x{i}", f"y{i % 11}"]) for _ in range(5))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lists = line_dedup.boilerplate(docs, F.col("source"), F.col("text"), 0.1, 3)
        plan = lists._jdf.queryExecution().executedPlan().toString()
        join = next(line for line in plan.split("\n") if "SortMergeJoin" in line or "ShuffledHashJoin" in line)
        assert "_salt" in join and "hashpartitioning" in plan
        got = {x["_host"]: len(x["_lines"]) for x in lists.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    pages, seen = {}, {}
    for _, h, t in rows:
        pages[h] = pages.get(h, 0) + 1
        for line in set(t.split("\n")):
            seen[h, line] = seen.get((h, line), 0) + 1
    want = {}
    for (h, _), n in seen.items():
        if n >= 3 and n > 0.1 * pages[h]:
            want[h] = want.get(h, 0) + 1
    assert got == want
