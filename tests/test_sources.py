"""Files, replies and periods that come from outside."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.functions.period import Selection, parse_card, parse_mode, parse_selection, validate
from tallyspark.operators import extraction as X
from tallyspark.operators import merchants as C
from tallyspark.operators.rollups import merchant_breakdown, top_category, top_merchant, totals_by_currency
from tallyspark.plans.dashboard import overview, summary
from tallyspark.sources import model


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_listed_by_one_scan_and_opened_by_another(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"text")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-" + bytes(1 << 20))
    files = model.scan_statement_files(spark, str(tmp_path), max_mb=1)
    scans = plan(files).split("FileScan binaryFile ")[1:]
    got = {r.path[-5:]: (r.length, r.rejected_reason, r.file_hash is None) for r in files.collect()}
    assert got == {"a.pdf": (10, None, False), "b.pdf": (4, "not a PDF", False), "c.pdf": (5 + (1 << 20), "too large", True)}
    assert len(scans) == 2 and "content" not in scans[0].split("]")[0] and "LessThanOrEqual(length,1048576)" in scans[1]


def test_broken_lines_have_a_channel(spark, tmp_path):
    lines = ['{"doc_id":"a","chunk_idx":0,"body":"x"}', '{"doc_id":"a","chunk_idx":1,"body":"cut', '{"doc_id":"b","chu', '{"do', '{"chunk_idx":3,"body":"no name"}', '{"doc_id":"c","chunk_idx":"two","body":"t"}', ""]
    (tmp_path / "p.json").write_text("\n".join(lines))
    good, rejected = model.split_corrupt(model.read_payloads(spark, str(tmp_path)))
    assert sorted((r.doc_id, r.chunk_idx, r.body) for r in good.collect()) == [("a", 0, "x"), ("a", 1, None), ("b", -1, None), ("c", -1, None)]
    assert sorted(r.error for r in rejected.collect()) == ["CorruptRecord: no doc_id", 'CorruptRecord: {"do'] and all(r.path.endswith("p.json") for r in rejected.collect())
    merged = {r.doc_id: (r.n_ok, r.n_failed) for r in X.merge_chunks(X.check_replies(X.parse_replies(good))).collect()}
    assert merged == {"a": (0, 2), "b": (0, 1), "c": (0, 1)}
    spark.createDataFrame([("a", 0, "x")], model.PAYLOADS).write.parquet(str(tmp_path / "q"))
    assert [tuple(r)[:3] for r in model.split_corrupt(model.read_payloads(spark, str(tmp_path / "q"), "parquet"))[0].collect()] == [("a", 0, "x")]


def test_keys_of_every_level_are_seen(spark):
    bodies = ['{"transactions":[{"date":"d","x":1},{"y":{}}],"metadata":{"z":null,"currency":"USD"},"q":[]}', '{"transactions":[],"metadata":{}}', '{"transactions":{"a":1},"metadata":[1]}', "[1]", "no json", None]
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select(X.extra_keys(F.try_parse_json("b")).alias("k")).collect()
    assert [sorted(r.k) for r in got] == [["metadata.z", "q", "transactions.x", "transactions.y"], [], [], [], [], []]


def test_fences(spark):
    cases = {"```json\n{}\n```": "{}", " ```JSON {} ``` \n": "{}", "```\n\n a ``` b\n```": "a ``` b", "``````": "", "```": "```", "`````": "`````", "x ```y```": "x ```y```", "```jsonx```": "x"}
    rows = spark.createDataFrame(list(cases.items()), "c string, want string").withColumn("got", T.strip_fence(F.col("c"))).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_envelopes(spark):
    cases = [
        ('{"choices":[{"message":{"content":"a"}}],"content":"z"}', "a"), ('{"choices":[{"content":"b"}]}', "b"), ('{"message":{"content":"c"}}', "c"), ('{"content":[{"type":"text","text":"d"},{"type":"tool"},{"type":"text","text":"e"}]}', "de"),
        ('{"content":"f"}', "f"), ('{"notes":"g"}', '{"notes":"g"}'), ('{"transactions":[]}', '{"transactions":[]}'), ('{"other":1}', None), ("{", None), (None, None),
    ]
    rows = spark.createDataFrame(cases, "body string, want string")
    got = rows.select("want", T.reply_content(F.try_parse_json("body"), F.col("body")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_exact_normalization(spark):
    cases = {"Ⓒⓐⓕⓔ": "cafe", "Ⅻ Tienda": "xii tienda", "𝔏𝔦𝔡𝔢𝔯 SpA": "lider", "ﬁn ½ SUC 3": "fin", "İstanbul": "istanbul", "漢字": "", "PARIS 03/06": "paris 03/06", "Ｆｕｌｌ": "full"}
    tx = spark.createDataFrame([(d,) for d in cases] + [(None,)], "description string")
    assert {r.description: r.canonical for r in C.with_canonical(tx).collect() if r.description} == cases


def test_selections():
    assert parse_card("") == parse_card("all") == "all" and parse_card("{12345678123456781234567812345678}") == "12345678-1234-5678-1234-567812345678"
    assert parse_selection("2026-07", "all", "0") == Selection(date(2026, 7, 1), "all", "ytd") and parse_mode(" ALL_TIME ") == "all_time" and parse_mode("") == "current" and parse_mode("Rolling_6") == "6"
    for bad in (lambda: parse_card("seven"), lambda: parse_mode("rolling_7"), lambda: parse_mode("5"), lambda: validate(merchants=0), lambda: validate(merchants=51)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        merchant_breakdown(None, None, limit=51)


def test_overview_equals_separate_answers(spark):
    rows = [(f"s{i % 3}", date(2026, 1 + i % 6, 1 + i % 28), 100 + 7 * i if i % 5 else -50, "CLP" if i % 2 else "USD", None if i % 7 == 0 else str(i % 4), None if i % 11 == 0 else f"m{i % 3}") for i in range(120)]
    tx = spark.createDataFrame(rows, "statement_id string, date date, amount int, currency string, category_id string, merchant_id string").withColumn("amount", F.col("amount").cast("decimal(15,2)"))
    statements = spark.createDataFrame([("s0", "a"), ("s1", "b"), ("s2", "a")], "id string, credit_card_id string")
    cats = spark.createDataFrame([(str(k), f"c{k}", 9 - k) for k in range(4)], "id string, name string, sort_order int")
    merchants = spark.createDataFrame([("m0", "zeta"), ("m1", "alpha")], "id string, name string")
    for selection in (Selection(date(2026, 4, 1), "a", "3"), Selection(date(2026, 4, 1), "b", "ytd"), Selection(date(2026, 3, 1), "all", "all_time"), Selection(date(2026, 9, 1), "a", "current")):
        got = overview(tx, selection, cats, merchants, statements=statements).collect()
        one = summary(tx, selection, statements=statements)
        assert {(r.currency, r.total, r.txn_count, r.daily_avg, r.month_total, r.prior_total, r.change_pct) for r in got if r.kind == "currency"} == {tuple(r) for r in one.drop("period_start", "period_end").collect()}
        own = tx if selection.card == "all" else tx.join(statements.where(F.col("credit_card_id") == selection.card).select(F.col("id").alias("statement_id")), "statement_id")
        start, end = selection.window(date(2026, 1, 1))
        own = own.where(F.col("date").between(F.lit(start), F.lit(end)))
        assert {(r.entity, r.currency, r.total) for r in got if r.kind == "category"} == {tuple(r) for r in top_category(own, cats).collect()}
        assert {(r.entity, r.name, r.currency, r.total) for r in got if r.kind == "merchant"} == {tuple(r) for r in top_merchant(own, merchants).collect()}
        assert {(r.currency, r.total, r.txn_count) for r in got if r.kind == "currency"} == {tuple(r) for r in totals_by_currency(own).collect()}
    text = plan(overview(tx, Selection(date(2026, 4, 1)), cats, merchants))
    assert text.count("Expand") == 1 and text.count("statement_id") <= 1


def test_only_plain_replies_are_spared_a_look_at_their_keys(spark):
    """Text that the pattern takes has no keys of its own; a fence's inside and a row's parsed fields are written once in the plan."""
    row = '{"date":"d \\\\"x\\\\": 1","amount":"}","installment_number":1}'
    plain_ = ["{}", '{"transactions":[],"notes":"a \\\\"mood\\\\":1 }"}', '{ "transactions" : [ %s , %s ],\n"metadata":{"currency":null},"confidence":-1.5e3}' % (row, row), '{"metadata":null,"transactions":null}', '{"metadata":{},"metadata":{}}']
    other = ['{"date":1}', '{"metadata":{"date":1}}', '{"transactions":[{"metadata":"x"}]}', '{"transactions":[{"date":{"a":1}}]}', '{"notes":["q"]}', '{"tr\\\\u0061nsactions":[]}', '{"Notes":"a"}', "{}x", "[]", "", '{"notes":"a}', '{"mood":1,"notes":"x"}']
    long = '{"transactions":[' + ",".join([row] * 20_000) + "]}"
    texts = [x.replace("\\\\", "\\") for x in [*plain_, *other, long]]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(X.plain_shape(X.EXTRACTION)).alias("p"), F.size(X.extra_keys(F.try_parse_json("t"))).alias("n")).collect()
    assert [r.p for r in got] == [True] * len(plain_) + [False] * len(other) + [True] and not any(r.n for r in got if r.p)
    p = spark.createDataFrame([("a", 0, texts[2])], model.PAYLOADS)
    assert plan(X.parse_replies(p)).count("$.choices[0].content") == 1
    typed = X.typed_rows(spark.createDataFrame([("01/02/2026", "1", "CLP"), ("x", "1", "CLP")], "date string, amount string, currency string"))
    assert typed.where("row_error is null").count() == 1
    times = [plan(df.select("parsed_date")).count("yyyy-MM-dd") for df in (typed, typed.where("row_error is null"))]
    assert times[0] == times[1]


def test_rejected_files_need_no_rows(spark, monkeypatch):
    """Replies and headers are written for them, not the rows of files that are taken."""
    from tallyspark.plans import ingest as I

    wrote = []
    monkeypatch.setattr(I, "staged", lambda df: wrote.append(df.columns) or df)
    p = spark.createDataFrame([("a", 0, "{"), ("b", 0, '{"transactions":[],"metadata":{"currency":"CLP"},"confidence":1}')], model.PAYLOADS)
    files = spark.createDataFrame([(d, 1, d, d, "NACIONAL") for d in "ab"], "doc_id string, bank_id long, file_path string, file_hash string, variant string")
    none = {"cards": "id string, bank_id long, card_number_masked string, cardholder string, currency string, is_active boolean", "aliases": "id string, merchant_id string, alias_text string, normalized string, source string, confidence double", "merchants": "id string, name string, default_category_id string, is_active boolean"}
    out = I.ingest(p, files, spark.createDataFrame([], model.STATEMENTS), *(spark.createDataFrame([], t) for t in none.values()), model.seed_categories(spark), date(2026, 3, 5))
    assert [r.doc_id for r in out.rejected.collect()] == ["a"] and len(wrote) == 2
    assert out.rejected is out.rejected and out.statements.count() == 1 and len(wrote) == 4


def test_chunks_leave_python_a_document_at_a_time(spark):
    """No array of a whole document's chunks, whatever their number; nulls have none."""
    docs = spark.createDataFrame([(1, "ab\n" * 1500), (2, None), (3, "")], "k long, t string")
    df = T.chunk_text(docs, "k", "t", size=4, overlap=1)
    got = sorted((r.k, r.chunk_idx, r.chunk) for r in df.collect())
    assert [x[:2] for x in got] == [*((1, i) for i in range(len(got) - 1)), (3, 0)] and len(got) > T.CHUNKS
    assert "".join([got[0][2], *(x[2][1:] for x in got[1:-1])]) == "ab\n" * 1500
    assert "MapInArrow" in plan(df) and "ArrowEvalPython" not in plan(df)
