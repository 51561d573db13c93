"""Commits of several tables at once, and partitions that queries prune."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.filters import filter_transactions, in_months_of, month_filter
from tallyspark.operators.recurring import detector_scan
from tallyspark.sources.model import STATEMENTS, TRANSACTIONS, load
from tallyspark.sources.snapshots import LEDGER, Change, Conflict, Snapshots


def postings(spark, rows):
    table = spark.createDataFrame(rows, "id string, statement_id string, date date, amount decimal(15,2)")
    names = {f.split()[0]: f.split()[1] for f in TRANSACTIONS.replace("decimal(15,2)", "decimal(15;2)").split(", ")}
    return table.select(*(F.col(n) if n in table.columns else F.lit(None).cast(t.replace(";", ",")).alias(n) for n, t in names.items()))


@pytest.fixture
def ledger(spark, tmp_path):
    at = Snapshots(spark, str(tmp_path / "ledger"))
    rows = [(f"{m}-{k}", f"s{m}", date(2026, m, k + 1), D(m)) for m in range(1, 7) for k in range(4)]
    made = spark.createDataFrame([(f"s{m}", "c", date(2026, m, 1), date(2026, m, 28), None, None, f"h{m}", "completed", None) for m in range(1, 7)], STATEMENTS)
    assert at.commit(0, {"transactions": Change(postings(spark, rows)), "statements": Change(made)}) == 1
    return at


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_readers_keep_their_version_and_only_touched_months_are_rewritten(spark, ledger):
    before = ledger.manifest()["tables"]["transactions"]
    held = ledger.read("transactions")
    edits = spark.createDataFrame([("3-0",), ("3-1",), ("none",)], "id string")
    assert ledger.partitions_of("transactions", edits) == ("2026-03",)
    assert ledger.rewrite("transactions", edits, lambda t: t.withColumn("category", F.lit("new"))) == 2
    assert {r.category for r in held.where("id = '3-0'").collect()} == {None}
    after = ledger.manifest()["tables"]["transactions"]
    assert len(set(before) & set(after)) == 5 and len(after) == 6
    assert ledger.read("transactions").where("category = 'new'").count() == 4 and ledger.read("transactions", 1).where("category = 'new'").count() == 0
    assert ledger.rewrite("transactions", edits.where("id = 'none'"), lambda t: t) == 2
    assert ids(ledger.read("transactions")) == ids(held)


def test_of_two_writers_on_one_base_the_second_is_refused(spark, ledger):
    other = Snapshots(spark, ledger.root)
    more = postings(spark, [("x", "s9", date(2026, 9, 1), D(1))])
    assert ledger.commit(1, {"transactions": Change(more)}, run=("stream", 7)) == 2
    with pytest.raises(Conflict):
        other.commit(1, {"transactions": Change(more.withColumn("id", F.lit("y")))})
    assert other.version() == 2 and "y" not in ids(other.read("transactions")) and (other.committed("stream"), other.committed("else")) == (7, -1)
    assert not [f for f in __import__("os").listdir(f"{ledger.root}/versions") if "draft" in f]


def test_a_writer_that_fails_changes_nothing(spark, ledger):
    bad = postings(spark, [("z", "s", date(2026, 1, 1), D(1))]).withColumn("description", F.raise_error(F.lit("lost")))
    made = ledger.read("statements").drop("bucket").withColumn("status", F.lit("failed"))
    before = ledger.read("statements").collect()
    with pytest.raises(Exception, match="lost"):
        ledger.commit(1, {"statements": Change(made, ()), "transactions": Change(bad)})
    assert ledger.version() == 1 and ledger.read("statements").collect() == before and "z" not in ids(ledger.read("transactions"))


def test_replaced_and_expired(spark, ledger):
    cards = spark.createDataFrame([("a", "b", "1", "A", "CLP", True)], LEDGER["cards"].schema)
    ledger.commit(1, {"cards": Change(cards)})
    ledger.commit(2, {"cards": Change(cards.withColumn("id", F.lit("b")), ())})
    assert ids(ledger.read("cards")) == ["b"] and ids(ledger.read("cards", 2)) == ["a"]
    assert ledger.expire(keep=1) == 1
    assert ids(ledger.read("cards")) == ["b"] and len(ids(ledger.read("transactions"))) == 24
    assert ledger.read("merchants").collect() == [] and ledger.read("rules").columns[-1] == "bucket"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_dates_prune_months(spark, ledger):
    tx = ledger.read("transactions")
    month = month_filter(tx, date(2026, 3, 15))
    text = plan(month)
    assert "PartitionFilters: [isnotnull(year_month" in text and "(year_month#" in text.split("PartitionFilters:")[1].split("\n")[0]
    assert ids(month) == [f"3-{k}" for k in range(4)] and "3 paths" not in text
    assert ids(filter_transactions(tx, date_from=date(2026, 5, 2))) == [f"{m}-{k}" for m in (5, 6) for k in range(4) if (m, k) > (5, 0)]
    files = {r[0].split("year_month=")[1][:7] for r in month.select(F.input_file_name()).collect()}
    assert files == {"2026-03"}


def test_bounds_from_a_table_prune_months_when_the_query_runs(spark, ledger):
    tx = ledger.read("transactions")
    bounds = spark.createDataFrame([(date(2026, 2, 3), date(2026, 3, 1))], "start date, end date")
    met = in_months_of(tx, bounds)
    assert "dynamicpruning" in plan(met) and ids(met) == [f"{m}-{k}" for m in (2, 3) for k in range(4)]
    assert in_months_of(tx.drop("year_month"), bounds).count() == 24
    named = tx.withColumn("card_id", F.lit("c")).withColumn("merchant_id", F.lit("m"))
    scan = detector_scan(named, ledger.read("statements"))
    assert "Subquery" in plan(scan).split("PartitionFilters:")[1].split("\n")[0]
    assert ids(scan) == ids(detector_scan(named.drop("year_month"), ledger.read("statements"))) == [f"{m}-{k}" for m in (4, 5, 6) for k in range(4)] + []


def test_load_reads_the_columns_asked_for(spark, ledger):
    assert "ReadSchema: struct<id:string>" in plan(load(spark, f"{ledger.root}/transactions", TRANSACTIONS).select("id"))
