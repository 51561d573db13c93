"""Plans that read and shuffle their rows once, against plain versions."""

import os
import random
import re
import tempfile
from datetime import date, timedelta
from decimal import Decimal as D
from statistics import median

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.recurring import recurring_group_stats, replay
from tallyspark.operators.rollups import monthly, monthly_window
from tallyspark.queries import QUERIES
from tallyspark.sources import model

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_stats_shuffle_counts_and_groups_once(spark):
    r, rows = random.Random(8), []
    for g in range(60):
        for _ in range(r.randrange(1, 40)):
            amount = None if r.random() < 0.05 else D(r.choice([1000, 1000, 1100, 1149, 1151, -1000, 0, r.randrange(-200, 2000)])) / 100
            rows.append((g, "m", "USD" if g % 7 else None, date(2024, 1, 1) + timedelta(r.randrange(40)), amount))
    got = recurring_group_stats(spark.createDataFrame(rows, "card_id int, merchant_id string, currency string, date date, amount decimal(15,2)"))
    assert plan(got).count("Exchange") == 2
    want = {}
    for g in range(60):
        own = [(d, a) for k, _, _, d, a in rows if k == g and a is not None]
        if not own:
            continue
        m = D(median(a for _, a in own)).quantize(D("0.001"))
        near = sorted((d, a) for d, a in own if m * D("0.85") <= a <= m * D("1.15"))
        gaps = [(b[0] - a[0]).days for a, b in zip(near, near[1:], strict=False)]
        if len(near) >= 3 and (days := round(median(gaps))) > 0:
            want[g] = (len(near), m, min(a for _, a in near), max(a for _, a in near), near[-1][0], days)
    assert {x.card_id: (x.n, x["median"], x.amount_min, x.amount_max, x.last_seen_date, x.period_days) for x in got.collect()} == want and len(want) > 10


def test_replay_detects_once(spark):
    """Rules and links read what was found; neither repeats the detections."""
    rows = [(f"t{i}", f"s{i // 2}", "c", date(2024, 1, 1) + timedelta(5 * i), D(10), "CLP", "m", None) for i in range(12)]
    tx = spark.createDataFrame(rows, "id string, statement_id string, card_id string, date date, amount decimal(15,2), currency string, merchant_id string, installment_number int")
    own = spark.createDataFrame([(f"s{i}", "c", date(2024, 1, 6) + timedelta(10 * i)) for i in range(6)], "id string, credit_card_id string, period_end date")
    rules, linked = replay(tx, own, spark.createDataFrame([], model.RULES))
    assert all("percentile" not in plan(x) and "Generate" not in plan(x) for x in (rules, linked))
    assert [(x.occurrences, x.period_days) for x in rules.collect()] == [(12, 5)] and linked.where("recurring_rule_id is not null").count() == 10


def test_monthly_change_reads_rows_once(spark):
    """The month before is the series' own, of any currency, or the calendar's in a window."""
    rows = [("2023-12", "USD", 10), ("2024-01", "USD", 20), ("2024-01", "CLP", 5), ("2024-02", "CLP", 0), ("2024-04", "USD", 30), ("2024-04", "CLP", 7), ("2024-05", None, 1), ("2024-06", "USD", 33), ("2024-07", "USD", None), ("2024-08", "USD", 44), (None, "USD", 9)]
    tx = spark.createDataFrame([(date.fromisoformat(f"{m}-05") if m else None, c, None if a is None else D(a)) for m, c, a in rows for _ in range(2)], "date date, currency string, amount decimal(15,2)")
    every, window = monthly(tx, 0, date(2024, 9, 1)), monthly_window(tx, date(2024, 1, 9), date(2024, 9, 1))
    got = {(x.month, x.currency): (int(x.total), x.prev_pct) for x in every.collect()}
    want = {("2023-12", "USD"): (20, None), ("2024-01", "USD"): (40, 100.0), ("2024-01", "CLP"): (10, None), ("2024-02", "CLP"): (0, -100.0), ("2024-04", "USD"): (60, None), ("2024-04", "CLP"): (14, None), ("2024-06", "USD"): (66, None), ("2024-08", "USD"): (88, None)}
    assert got == want
    held = {(x.month, x.currency): (x.total and int(x.total), x.prev_pct) for x in window.collect()}
    empty = {(m, None): (None, None) for m in ("2024-03", "2024-05", "2024-07", "2024-09")}
    assert held == {k: v for k, v in want.items() if k[0] > "2024"} | {("2024-01", "USD"): (40, None)} | empty
    tx.write.mode("overwrite").parquet(folder := tempfile.mkdtemp(prefix="spark-"))
    stored = spark.read.parquet(folder)
    assert plan(monthly(stored, 0, date(2024, 9, 1))).count("FileScan") == 1 == plan(monthly_window(stored, date(2024, 1, 9), date(2024, 9, 1))).count("FileScan")


def test_overview_joins_a_cards_lines_only(spark):
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    text = QUERIES["series_overview"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [l_orderkey") == 1
    # orders are read for the lines and as statements, each for the card alone
    assert text.count("Relation [o_orderkey") == 2 == len(re.findall(r"o_custkey#\d+L? = 7\)", text))


NONE = {"cards": "id string, bank_id long, card_number_masked string, cardholder string, currency string, is_active boolean", "aliases": "id string, merchant_id string, alias_text string, normalized string, source string, confidence double", "merchants": "id string, name string, default_category_id string, is_active boolean"}


def test_replies_are_dealt_once_and_headers_not_at_all(spark, monkeypatch):
    """Chunks and files that come dealt by document are read, freed of copies, typed and headed where they are; files of one doc_id stay apart."""
    from tallyspark.plans import ingest as I

    wrote, staged = [], I.staged
    monkeypatch.setattr(I, "staged", lambda df: wrote.append(df) or staged(df))
    row = '{"date":"01/02/2026","description":"%s","amount":"%s","currency":"CLP"}'
    body = lambda *rows, at="": '{"transactions":[%s],"metadata":{"card_number_masked":"%s","currency":"CLP"},"confidence":0.5}' % (",".join(row % r for r in rows), at)
    chunks = [("a", 0, body(("x", "1"), ("X ", "1"))), ("a", 1, body(("x", " 1"), at="7")), ("a", 1, body(("y", "2"))), ("a", None, None), ("b", 0, body(("x", "1"), at="8")), ("b", 1, body(("z", "-"))), ("c", 0, body()), (None, 0, body(("n", "1")))]
    p = spark.createDataFrame(chunks, model.PAYLOADS).repartition("doc_id")
    files = [("a", 1, "p", "h1", "NACIONAL"), ("a", 1, "p", "h1", "NACIONAL"), ("a", 1, "q", "h1", "NACIONAL"), ("a", 1, "q", "h2", "INTERNACIONAL"), ("a", 2, "q", "h2", "NACIONAL"), ("b", 1, "p", "h1", "NACIONAL"), ("c", 1, "p", "h3", "NACIONAL"), ("d", None, "p", "h4", "NACIONAL"), (None, 1, "p", "h5", "NACIONAL"), ("c", None, "p", "h6", "NACIONAL")]
    f = spark.createDataFrame(files, "doc_id string, bank_id long, file_path string, file_hash string, variant string").repartition("doc_id")
    out = I.ingest(p, f, spark.createDataFrame([], model.STATEMENTS), *(spark.createDataFrame([], t) for t in NONE.values()), model.seed_categories(spark), date(2026, 3, 5))
    made = sorted((x.file_hash, x.status, x.error_message) for x in out.statements.collect())
    assert made == [("h1", "completed", None), ("h1", "failed", "AmountError: -"), ("h2", "completed", None), ("h3", "completed", None)]
    assert sorted((str(x.doc_id), x.error.partition(": ")[2]) for x in out.rejected.collect()) == [("None", "no chunks"), ("a", "metadata currency is not the variant's"), ("d", "no chunks")]
    assert sorted((x.description, int(x.amount)) for x in out.transactions.collect()) == [("x", 1)] * 2 + [("y", 2)] * 2
    assert plan(wrote[0]).count("Exchange hashpartitioning(doc_id") == 2 == plan(wrote[0]).count("Exchange hashpartitioning") and "Exchange" not in plan(wrote[1])
    # files and rows are sorted once each
    assert len(re.findall(r"Sort \[doc_id", plan(wrote[0]))) == 2


def test_postings_are_not_dealt_by_what_they_name(spark):
    """A few merchants have most postings: descriptions are resolved once each, and what they name is written, so that its size is known."""
    from tallyspark.plans import ingest as I

    row = '{"date":"01/02/2026","description":"%s","amount":"%d","currency":"CLP","category":"Groceries"}'
    p = spark.createDataFrame([(str(d), 0, '{"transactions":[%s],"metadata":{"currency":"CLP"},"confidence":0.5}' % ",".join(row % ("Bazar %d" % (k % 2), k) for k in range(4))) for d in range(8)], model.PAYLOADS)
    f = p.select("doc_id", F.lit(1).cast("long").alias("bank_id"), F.col("doc_id").alias("file_path"), F.col("doc_id").alias("file_hash"), F.lit("NACIONAL").alias("variant"))
    out = I.ingest(p, f, spark.createDataFrame([], model.STATEMENTS), *(spark.createDataFrame([], t) for t in NONE.values()), model.seed_categories(spark), date(2026, 3, 5))
    assert "Exchange hashpartitioning" not in plan(out.transactions)
    assert out.transactions.count() == 32 and [x.name for x in out.merchants.collect()] == ["bazar"] and out.aliases.count() == 1


def test_replies_in_the_schemas_order_need_no_variant(spark):
    """The pattern takes valid JSON alone, with known keys once each, and what it takes is parsed to the same reply as in an envelope."""
    import json

    from tallyspark.operators import extraction as X

    r = random.Random(5)
    one = {"date": "01/02/2026", "description": 'a "q" \\ é \n```', "amount": "1.000,50", "currency": "USD", "category": None, "installment_number": 1, "installment_total": 12, "installment_value": -1.5e3}
    whole = {"transactions": [one, {}, None, {"amount": 5}], "metadata": {"cardholder": "x", "statement_date": ""}, "confidence": 0.25, "notes": True}
    texts = [json.dumps(whole), json.dumps(whole, indent=1), '{"transactions":null}', " " + json.dumps({"transactions": [one] * 20_000}) + "\n"]
    base, wild = texts[0], ['"', "}", "{", "]", "[", ",", ":", "1", "0", "\\", "\n", " ", "null", '"notes"', '"date":1,', "tru", "\x01", "e5", "."]
    for _ in range(1500):
        at = r.randrange(len(base))
        texts.append(base[:at] + r.choice(wild) + base[at + r.randrange(3) :])
    texts += ['{"metadata":{},"transactions":[]}', '{"transactions":[],"transactions":[]}', '{"transactions":[{"date":1,"date":2}]}', '{"notes":"x"}', '{"transactions":[],}', '{"transactions":[{},]}', '{"transactions":[]} {}', '{"transactions":[1]}', '{"transactions":[],"confidence":01}']
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_idx int, body string").withColumn("doc_id", F.lit("d"))
    got = {x.chunk_idx: x for x in df.select("chunk_idx", F.col("body").rlike(X.ordered_shape(X.EXTRACTION)).alias("bare"), F.try_parse_json("body").isNotNull().alias("valid"), F.size(X.extra_keys(F.try_parse_json("body"))).alias("extra")).collect()}
    bare = {k for k, x in got.items() if x.bare}
    assert {0, 1, 2, 3} <= bare and len(bare) > 100 and all(got[k].valid and got[k].extra <= 0 for k in bare) and not bare & set(range(len(texts) - 9, len(texts)))
    wrapped = df.withColumn("body", F.to_json(F.struct(F.col("body").alias("content"))))
    plain_, inside = ({x.chunk_idx: x for x in X.parse_replies(y).where("chunk_idx <> 3").collect()} for y in (df, wrapped))
    assert all(plain_[k] == inside[k] for k in bare - {3})


def test_dates_are_parsed_as_a_formatter_would(spark):
    from tallyspark.functions.text import parse_date

    r = random.Random(6)
    texts = ["".join(r.choice(["0", "1", "2", "3", "9", "/", "-", " ", "\n"]) for _ in range(r.randrange(12))) for _ in range(300)]
    for _ in range(1500):
        d, m, y = f"{r.randrange(34):02}", f"{r.randrange(14):02}", f"{r.choice([r.randrange(10000), r.randrange(1900, 2030)]):04}"
        texts.append(r.choice([f"{d}/{m}/{y}", f"{d}/{m}/{y[2:]}", f"{y}-{m}-{d}"]) + r.choice(["", "", "", "\n", " ", "\r\n"]))
    c = F.col("t")
    day, month, year = (F.regexp_extract(c, r"^(\d{2})/(\d{2})/(\d{2}|\d{4})$", k) for k in (1, 2, 3))
    full = F.when(F.length(year) == 4, year).when(year >= "70", F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))
    slashed = F.try_to_timestamp(F.concat_ws("-", full, month, day), F.lit("yyyy-MM-dd")).cast("date")
    want = F.when(day != "", slashed).when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", parse_date(c).cast("string").alias("got"), want.cast("string").alias("want")).collect()
    assert [x for x in rows if x.got != x.want] == [] and sum(x.got is not None for x in rows) > 500
