"""Arrival of statements: each is ingested once; rules and links are brought up to date after its rows are written.

What a batch needs to know of earlier ones is state, kept by card in RocksDB: the files a card has had, and its
open postings, those of the last ``LOOKBACK_DAYS + late_days`` days.  So a batch reads neither the ledger's
keys nor its cards' history.  A statement that ends more than ``late_days`` before its card's newest may need postings
that are no longer open; only for such ones the rows of their cards are read again.
"""

import json
import uuid
from collections.abc import Iterator
from datetime import date, timedelta
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.recurring import KEY, LOOKBACK_DAYS, after_detections, arrival_scans, arrival_stats
from ..sources.model import RULES
from ..sources.snapshots import BUCKETS
from ..sources.staging import staged
from .arrivals import use_rocksdb

POSTINGS = "id string, card_id string, statement_id string, file_hash string, period_end date, date date, amount decimal(15,2), currency string, merchant_id string, installment_number int"
LINKS = "id string, recurring_rule_id string"
COLUMNS = [f.split()[0] for f in POSTINGS.replace("(15,2)", "").split(", ")]
SEEN = f"kind string, {POSTINGS}, at string, at_end date"


def stream_statements(spark: SparkSession, path: str, schema: str = POSTINGS, per_batch: int | None = None) -> DataFrame:
    """Postings of statements as their Parquet files arrive; all of a statement's are in one file."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


class History(StatefulProcessor):
    """For a card and a share of its merchants: own rows of files that are new, and the postings that detection at each of their statements sees.

    Of a file's statements in a batch the least id is kept.  A statement too late for the open postings is named instead.
    """

    def __init__(self, lookback: int, late_days: int):
        self.lookback, self.late_days = lookback, late_days

    def init(self, handle) -> None:
        self.files = handle.getMapState("files", "file_hash string", "statement_id string")
        self.open = handle.getMapState("open", "statement_id string", "period_end date, last date, rows string")
        self.newest = handle.getValueState("newest", "period_end date")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True)
        least = got.groupby("file_hash")["statement_id"].min()
        fresh = {s: h for h, s in least.items() if not self.files.containsKey((h,))}
        for statement, file_hash in fresh.items():
            self.files.updateValue((file_hash,), (statement,))
        got = got[[fresh.get(s) == h for s, h in zip(got["statement_id"], got["file_hash"], strict=True)]]
        own = got[got["own"]].drop_duplicates(["file_hash", "id"])
        yield self._out(own.assign(kind="own", at=None, at_end=None))
        newest = self.newest.get()[0] if self.newest.exists() else None
        ends = {s: max(e) for s, e in ((s, [x for x in g if not pd.isna(x)]) for s, g in got.groupby("statement_id")["period_end"]) if e}
        late = [s for s, e in ends.items() if newest and e < newest - timedelta(days=self.late_days)]
        yield self._out(pd.DataFrame([{"kind": "late", "card_id": key[0], "statement_id": s, "period_end": ends[s]} for s in sorted(late)], columns=["kind", *COLUMNS, "at", "at_end"]))
        seen = [(i[0], v[0], v[1], self._rows(v[2])) for i, v in self.open.iterator()]
        usable = own[own["installment_number"].isna() & own["merchant_id"].notna()]
        for at in sorted(ends, key=lambda s: (ends[s], s)):
            r = usable[usable["statement_id"] == at]
            postings = list(zip(r["id"], r["date"], r["amount"], r["currency"], r["merchant_id"], strict=True))
            if postings:
                last = max(p[1] for p in postings)
                text = json.dumps([(p[0], p[1].isoformat(), str(p[2]), p[3], p[4]) for p in postings])
                self.open.updateValue((at,), (ends[at], last, text))
                seen.append((at, ends[at], last, postings))
            if at not in late:
                since = ends[at] - timedelta(days=self.lookback)
                scan = [("scan", *p, s, key[0], at, ends[at]) for s, _, last, ps in seen if s not in late or s == at for p in ps if p[1] >= since] if at else []
                yield self._out(pd.DataFrame(scan, columns=["kind", "id", "date", "amount", "currency", "merchant_id", "statement_id", "card_id", "at", "at_end"]))
        newest = max([*([newest] if newest else []), *ends.values()], default=None)
        if newest:
            self.newest.update((newest,))
            for statement, _, last, _ in seen:
                if last < newest - timedelta(days=self.lookback + self.late_days):
                    self.open.removeKey((statement,))

    @staticmethod
    def _rows(text: str) -> list[tuple]:
        return [(i, date.fromisoformat(d), Decimal(a), c, m) for i, d, a, c, m in json.loads(text)]

    @staticmethod
    def _out(rows: pd.DataFrame) -> pd.DataFrame:
        full = rows.reindex(columns=["kind", *COLUMNS, "at", "at_end"])
        full["installment_number"] = full["installment_number"].astype("Int32")
        return full.astype({c: object for c in full.columns if c != "installment_number"}).where(full.notna(), None).astype({"installment_number": "Int32"})

    def close(self) -> None:
        pass


def with_history(stream: DataFrame, late_days: int = 365, shares: int = 4) -> DataFrame:
    """Rows of History.  A card's merchants and currencies are dealt to ``shares`` states, so a busy card is not one task; each hears of every statement."""
    use_rocksdb(stream.sparkSession)
    share = F.pmod(F.xxhash64("merchant_id", "currency"), F.lit(shares)).cast("int")
    dealt = stream.where("card_id is not null and file_hash is not null and statement_id is not null").withColumn("_own", share)
    dealt = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("own", F.col("share") == F.col("_own"))
    kept = ("card_id", "statement_id", "file_hash", "period_end")
    rows = dealt.select("card_id", "share", *(F.col(c) if c in kept else F.when(F.col("own"), F.col(c)).alias(c) for c in COLUMNS if c != "card_id"), "own")
    return rows.groupBy("card_id", "share").transformWithStateInPandas(History(LOOKBACK_DAYS, late_days), SEEN, "Append", "None")


def _before(spark: SparkSession, path: str, number: int) -> DataFrame:
    """Postings that earlier batches wrote: a batch that is run again must not see its own rows."""
    return spark.read.schema(POSTINGS + ", batch long").option("basePath", path).parquet(path).where(F.col("batch") < number).drop("batch")


def _statements(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("card_id").alias("credit_card_id"), F.col("statement_id").alias("id")).agg(F.max("period_end").alias("period_end"))


def _late_scans(own: DataFrame, late: DataFrame, ledger: DataFrame) -> DataFrame:
    """What statements see that are too late for state: earlier postings of their cards, and their own."""
    rows = ledger.join(late.select("card_id").distinct(), "card_id", "left_semi").unionByName(own.join(late.select("statement_id"), "statement_id", "left_semi").select(*COLUMNS))
    arrived = late.select(F.col("card_id").alias("credit_card_id"), F.col("statement_id").alias("id"), "period_end")
    return arrival_scans(rows, _statements(rows), arrived)


def ingest(stream: DataFrame, ledger_path: str, rules_path: str, links_path: str, log_path: str, checkpoint: str, late_days: int = 365, shares: int = 4):
    """The running query.  A failed detection is logged and does not undo the rows written before it.

    A batch's rows go to a folder of its number, so a batch that is run again replaces its own.  Detection runs for the
    statements of the batch, in order of (period_end, id).  Each batch leaves links of its own postings, and the
    buckets of rules that it met; the last of each bucket are the current ones.
    """
    spark = stream.sparkSession
    for path, schema in ((f"{ledger_path}/batch=-1", POSTINGS), (f"{rules_path}/batch=-1/bucket=-1", RULES), (f"{links_path}/batch=-1", LINKS)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = staged(batch)  # state is written with it, so the batch must not run twice
        own = rows.where("kind = 'own'").select(*COLUMNS)
        own.write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")
        try:
            scan = rows.where("kind = 'scan'").select("id", "card_id", "statement_id", "date", "amount", "currency", "merchant_id", "at", "at_end")
            late = rows.where("kind = 'late'").select("card_id", "statement_id", "period_end").distinct()
            if not late.isEmpty():
                scan = scan.unionByName(_late_scans(own, late, _before(spark, ledger_path, number)).select(*scan.columns))
            found = staged(arrival_stats(scan).withColumn("bucket", _bucket()))
            met = sorted(r[0] for r in found.select("bucket").distinct().collect())  # BUCKETS at most
            rules, linked = after_detections(found.drop("bucket"), own, current_rules(spark, rules_path, number, met))
            rules.withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{rules_path}/batch={number}")
            linked.where("recurring_rule_id is not null").select("id", "recurring_rule_id").write.mode("overwrite").parquet(f"{links_path}/batch={number}")
            _forget(spark, rules_path, met, number)
            report = spark.createDataFrame([(number, "ok", None)], "batch long, status string, message string")
        except Exception as error:  # noqa: BLE001  detection must not undo the ingest
            report = spark.createDataFrame([(number, "failed", str(error)[:500])], "batch long, status string, message string")
        report.write.mode("overwrite").parquet(f"{log_path}/batch={number}-{uuid.uuid4().hex[:8]}")

    out = with_history(stream, late_days, shares).writeStream.foreachBatch(on_batch).outputMode("append")
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bucket():
    return F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")


def current_rules(spark: SparkSession, rules_path: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The rules as the last batch that met their bucket left them; of batches before a number, and of some buckets."""
    rules = spark.read.schema(RULES + ", batch long, bucket int").option("basePath", rules_path).parquet(rules_path)
    rules = rules if before is None else rules.where(F.col("batch") < before)
    rules = rules if buckets is None else rules.where(F.col("bucket").isin(buckets))
    last = rules.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rules.join(F.broadcast(last), ["batch", "bucket"], "left_semi").drop("batch", "bucket")


def _forget(spark: SparkSession, rules_path: str, buckets: list[int], number: int) -> None:
    """Deletes what earlier batches left of some buckets, but for the last before this one, which a second run of it needs."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(rules_path).getFileSystem(spark._jsc.hadoopConfiguration())
    for b in buckets:
        there = {int(str(f.getPath()).split("/batch=")[1].split("/")[0]): f.getPath() for f in fs.globStatus(hadoop.Path(f"{rules_path}/batch=*/bucket={b}")) or []}
        for n in sorted(n for n in there if n < number)[:-1]:
            fs.delete(there[n], True)
