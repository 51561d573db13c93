"""Files that arrive in parts, against the batch plan over all of them."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.plans.ingest import ingest, ingest_into
from tallyspark.sources import model
from tallyspark.sources.snapshots import LEDGER, Snapshots
from tallyspark.streaming.arrivals import ARRIVALS, as_arrivals, ingest_arrivals, read_arrivals

AS_OF, START = date(2026, 3, 5), datetime(2026, 3, 5, 12)


def body(k, n):
    rows = [{"date": f"{1 + n:02d}/02/2026", "description": f"Shop {'abcdef'[k]} {n}", "amount": "$ 1.000", "currency": "EUR" if k == 3 else "CLP", "category": "groceries"}]
    meta = {"card_number_masked": str(k % 2), "cardholder": "A", "currency": "CLP", "period_start": "", "period_end": "2026-02-28", "statement_date": ""}
    return json.dumps({"transactions": rows, "metadata": meta, "confidence": 0.9, "notes": ""})


@pytest.fixture
def parts(spark):
    payloads = [(f"f{k}", n, None if (k, n) == (2, 1) else body(k, n)) for k in range(6) for n in range(k)]
    files = spark.createDataFrame([(f"f{k}", "b", f"{k}.pdf", f"h{k}", "NACIONAL") for k in range(6)], "doc_id string, bank_id string, file_path string, file_hash string, variant string")
    return files, spark.createDataFrame(payloads, "doc_id string, chunk_idx int, body string")


def arrive(spark, at, ledger, checkpoint, rows, **more):
    """Each list of rows is a file of the stream, and a batch."""
    for part in rows:
        spark.createDataFrame(part, ARRIVALS).coalesce(1).write.mode("append").parquet(at)
    ingest_arrivals(read_arrivals(spark, at, per_batch=1), ledger, model.seed_categories(spark), AS_OF, checkpoint, wait=600, **more).awaitTermination(300)


def tables(read):
    tx = read("transactions").drop("year_month")
    return {n: sorted(repr(tuple(r)) for r in df.collect()) for n, df in (("transactions", tx), ("statements", read("statements").drop("bucket")), ("cards", read("cards")), ("rejected", read("rejected").select("doc_id", "error")), ("merchants", read("merchants").select("id", "name")))}


def test_any_order_and_batches_give_the_batch_plans_tables(spark, tmp_path, parts):
    none = {n: spark.createDataFrame([], LEDGER[n].schema) for n in LEDGER}
    out = ingest(parts[1], parts[0], none["statements"], none["cards"], none["aliases"], none["merchants"], model.seed_categories(spark), AS_OF)
    want = tables(lambda n: getattr(out, n))
    rows = as_arrivals(*parts, F.lit(START)).collect()
    r = random.Random(1)
    r.shuffle(rows)
    again = rows[:3]  # some come twice
    cuts = sorted(r.sample(range(1, len(rows)), 2))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)] + [again]
    ledger = Snapshots(spark, str(tmp_path / "ledger"))
    arrive(spark, str(tmp_path / "in"), ledger, str(tmp_path / "checkpoint"), batches)
    assert tables(ledger.read) == want and len(want["transactions"]) == 11 and len(want["statements"]) == 5
    # files of the batch plan that are there already add nothing
    ingest_into(ledger, parts[1], parts[0].where("doc_id > 'f2'"), model.seed_categories(spark), AS_OF)
    assert tables(ledger.read) == want


def test_a_file_whose_chunk_never_comes_is_rejected_by_the_timer(spark, tmp_path, parts):
    rows = as_arrivals(*parts, F.lit(START)).collect()
    of = lambda doc, keep=lambda r: True: [r for r in rows if r.doc_id == doc and keep(r)]
    some = of("f3", lambda r: r.chunk_idx != 1) + of("f4", lambda r: r.n_chunks is None)
    tick = [r.asDict() | {"arrived": START + timedelta(seconds=s)} for s, r in [(300, of("f1")[0]), (765, of("f2")[0])]]
    names = [f.split()[0] for f in ARRIVALS.split(", ")]
    later = [[tuple(t[n] for n in names)] for t in tick]
    ledger = Snapshots(spark, str(tmp_path / "ledger"))
    at = str(tmp_path / "in"), ledger, str(tmp_path / "checkpoint")
    arrive(spark, *at, [[tuple(r[n] for n in names) for r in some], *later[:1]])
    assert ledger.read("rejected").collect() == []
    arrive(spark, *at, later[1:])
    assert {(r.doc_id, r.error) for r in ledger.read("rejected").collect()} == {("f3", "TimeoutError: 2 of 3 chunks came"), ("f4", "TimeoutError: no header came")}
    # what was missing comes too late
    arrive(spark, *at, [[tuple((r.asDict() | {"arrived": START + timedelta(seconds=766)})[n] for n in names) for r in of("f3") + of("f4")]])
    assert ledger.read("transactions").collect() == [] and len(ledger.read("rejected").collect()) == 2
