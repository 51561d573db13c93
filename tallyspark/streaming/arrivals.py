"""Files whose header and chunks arrive apart: state holds them until a file is whole, or its time is up.

The stream has a row for each header (n_chunks given) and for each chunk (chunk_idx given) of a file,
in any order and in any batch.  State is kept by file in RocksDB.  When header and all chunks are there the file
is handed on, once; rows that come again after that are dropped.  A timer set at a file's first row hands on
what is missing.  Its clock is the stream's watermark, or the time of day for streams that may fall silent.
"""

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..plans.ingest import ingest_into
from ..sources.snapshots import Snapshots
from ..sources.staging import staged

ARRIVALS = "doc_id string, arrived timestamp, bank_id string, file_path string, file_hash string, variant string, n_chunks int, chunk_idx int, body string"
HEADER = ["bank_id", "file_path", "file_hash", "variant", "n_chunks"]
ASSEMBLED = "doc_id string, bank_id string, file_path string, file_hash string, variant string, n_chunks int, chunk_idx int, body string, error string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State of processors with variables of their own is kept in RocksDB."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Assembler(StatefulProcessor):
    """Rows of a whole file: one for each chunk, or one without a chunk where it has none; or one with an error when its time is up."""

    def __init__(self, wait_ms: int, event_time: bool):
        self.wait_ms, self.event_time = wait_ms, event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.header = handle.getValueState("header", "bank_id string, file_path string, file_hash string, variant string, n_chunks int")
        self.chunks = handle.getMapState("chunks", "chunk_idx int", "body string")
        self.closed = handle.getValueState("closed", "closed boolean")

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.closed.exists():
            return
        began = None
        for part in rows:
            first = int(part["arrived"].min().timestamp() * 1000)
            began = first if began is None else min(began, first)
            for r in part[part["n_chunks"].notna()].head(1).itertuples():
                if not self.header.exists():
                    self.header.update(tuple(None if pd.isna(getattr(r, c)) else getattr(r, c) for c in HEADER[:-1]) + (int(r.n_chunks),))
            for r in part[part["chunk_idx"].notna()].itertuples():
                at = (int(r.chunk_idx),)
                if not self.chunks.containsKey(at):
                    self.chunks.updateValue(at, (None if pd.isna(r.body) else r.body,))
        whole = self._whole(key[0])
        if whole is not None:
            self._close(timerValues)
            yield whole
        elif not list(self.handle.listTimers()):
            self.handle.registerTimer((began if self.event_time else self._now(timerValues)) + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.closed.exists():
            self.closed.clear()
            return
        header = self.header.get() if self.header.exists() else (None,) * 5
        came = sum(1 for _ in self.chunks.keys())
        error = f"TimeoutError: {came} of {header[4]} chunks came" if self.header.exists() else "TimeoutError: no header came"
        self._close(timerValues)
        yield pd.DataFrame([(key[0], *header, None, None, error)], columns=["doc_id", *HEADER, "chunk_idx", "body", "error"]).astype({"n_chunks": "Int32", "chunk_idx": "Int32"})

    def _whole(self, doc: str) -> pd.DataFrame | None:
        header = self.header.get() if self.header.exists() else None
        if header is None:
            return None
        there = [(k[0], v[0]) for k, v in self.chunks.iterator()]
        if len({k for k, _ in there if 0 <= k < header[4]}) < header[4]:
            return None
        rows = [(doc, *header, k, body, None) for k, body in sorted(there, key=lambda x: x[0]) if 0 <= k < header[4]] or [(doc, *header, None, None, None)]
        return pd.DataFrame(rows, columns=["doc_id", *HEADER, "chunk_idx", "body", "error"]).astype({"n_chunks": "Int32", "chunk_idx": "Int32"})

    def _close(self, timerValues) -> None:
        """Forgets a file's rows, and after as long again that it was there."""
        self.header.clear()
        self.chunks.clear()
        self.closed.update((True,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(self._now(timerValues), 0) + 2 * self.wait_ms)

    def close(self) -> None:
        pass


def assembled(arrivals: DataFrame, wait: int, event_time: bool = True, late: str = "1 minute") -> DataFrame:
    """Rows of files that are whole, or whose time is up after ``wait`` seconds.

    With event time, the clock is the latest arrival less ``late``; rows older than that are too late for it.
    """
    use_rocksdb(arrivals.sparkSession)
    rows = arrivals.where("doc_id is not null and arrived is not null")
    rows = rows.withWatermark("arrived", late) if event_time else rows
    return rows.groupBy("doc_id").transformWithStateInPandas(Assembler(wait * 1000, event_time), ASSEMBLED, "Append", "EventTime" if event_time else "ProcessingTime")


def ingest_arrivals(arrivals: DataFrame, ledger: Snapshots, categories: DataFrame, as_of: date, checkpoint: str, wait: int = 3600, writer: str = "arrivals", event_time: bool = True, late: str = "1 minute", trigger: dict | None = None):
    """The running query: each batch's whole files are ingested and committed at once, with the files that are rejected.

    A batch that is run again after its commit is known by its number and skipped.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        rows = staged(batch)  # state is written with it, so the batch must not run twice
        if ledger.committed(writer) >= number or rows.isEmpty():
            return
        whole = rows.where("error is null")
        files = whole.select("doc_id", "bank_id", "file_path", "file_hash", "variant").distinct()
        payloads = whole.where("chunk_idx is not null").select("doc_id", "chunk_idx", "body")
        ingest_into(ledger, payloads, files, categories, as_of, rows.where("error is not null").select("doc_id", "error"), run=(writer, number))

    out = assembled(arrivals, wait, event_time, late).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def read_arrivals(spark, path: str, per_batch: int | None = None) -> DataFrame:
    """Headers and chunks as their Parquet files arrive."""
    reader = spark.readStream.schema(ARRIVALS)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


def as_arrivals(files: DataFrame, payloads: DataFrame, arrived: F.Column) -> DataFrame:
    """Headers of files(doc_id, bank_id, file_path, file_hash, variant) and chunks of payloads as rows of a stream; a header tells how many chunks there are."""
    n = payloads.groupBy("doc_id").agg(F.countDistinct("chunk_idx").cast("int").alias("n_chunks"))
    heads = files.join(n, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    both = heads.unionByName(payloads, allowMissingColumns=True).withColumn("arrived", arrived)
    names = [f.split()[0] for f in ARRIVALS.split(", ")]
    return both.select(*(F.col(n).cast(f.split()[1]) for n, f in zip(names, ARRIVALS.split(", "), strict=True)))


__all__ = ["ARRIVALS", "ASSEMBLED", "Assembler", "as_arrivals", "assembled", "ingest_arrivals", "read_arrivals"]
