"""Detection from state against replay over the whole ledger."""

import random
from datetime import date, timedelta
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyspark.operators.recurring import KEY, replay
from tallyspark.sources.model import RULES
from tallyspark.streaming.statements import COLUMNS, POSTINGS, current_rules, ingest, stream_statements


def make_postings():
    r, rows = random.Random(9), []
    for i in range(260):
        day = date(2026, 1, 1) + timedelta(days=r.randrange(240))
        card = r.choice("ab")
        rows.append([str(i), card, f"{card}{day:%m}", f"h{card}{day:%m}", None, day, D(r.choice(["10.00", "10.00", "10.50", "40.00", "-3.00"])), r.choice(["CLP", "USD"]), r.choice(["m", "n", "o", None]), r.choice([None, None, None, 1])])
    ends = {s: max(x[5] for x in rows if x[2] == s) for s in {x[2] for x in rows}}
    return [tuple(x[:4] + [ends[x[2]]] + x[5:]) for x in rows]


def test_shuffled_arrivals_equal_replay(spark, tmp_path):
    rows = make_postings()
    names = sorted({x[2] for x in rows})
    random.Random(2).shuffle(names)
    batches = [names[:6], names[6:9], names[9:]]
    source, at = str(tmp_path / "in"), [str(tmp_path / n) for n in ("ledger", "rules", "links", "log", "checkpoint")]
    tables = [spark.createDataFrame([x for x in rows if x[2] in b], POSTINGS) for b in batches]
    for t in tables:
        # the second copy of a file has another statement, whose id is greater
        t.unionByName(t.withColumn("statement_id", F.concat("statement_id", F.lit("z")))).coalesce(1).write.mode("append").parquet(source)
    ingest(stream_statements(spark, source, per_batch=1), *at, late_days=40, shares=2).awaitTermination(300)
    assert {r.status for r in spark.read.parquet(at[3]).collect()} == {"ok"}

    rules, tx = spark.createDataFrame([], RULES), None
    for t in tables:
        t = t.drop("file_hash").withColumn("recurring_rule_id", F.lit(None).cast("string"))
        tx = t if tx is None else tx.unionByName(t)
        statements = lambda df: df.groupBy(F.col("card_id").alias("credit_card_id"), F.col("statement_id").alias("id")).agg(F.max("period_end").alias("period_end"))
        rules, tx = replay(tx, statements(tx), rules, statements(t))
        rules, tx = spark.createDataFrame(rules.collect(), rules.schema), spark.createDataFrame(tx.collect(), tx.schema)
    plain = lambda df: sorted(repr(tuple(r)) for r in df.select(*KEY, "occurrences", "last_seen_date", "confidence", "period_label", "is_active").collect())
    now = current_rules(spark, at[1])
    assert plain(now) == plain(rules) and now.count() > 10
    links = {(r.id, r.recurring_rule_id) for r in spark.read.parquet(at[2]).collect()}
    assert links == {(r.id, r.recurring_rule_id) for r in tx.where("recurring_rule_id is not null").collect()} and len(links) > 50
    ledger = spark.read.parquet(at[0]).select(*COLUMNS).collect()
    assert sorted(map(tuple, ledger), key=repr) == sorted(rows, key=repr)
