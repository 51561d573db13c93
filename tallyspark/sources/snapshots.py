"""Tables in versioned directories, several of them changed in one commit.

Rows are Parquet under ``root/<table>/[<partition>=<value>/]commit=<id>``, which nothing ever
overwrites.  A version is one small file, ``root/versions/<number>``, that names the directories of every
table.  A commit writes its directories first and its version last, by a rename that fails where the
number is taken: a writer that dies before it leaves only directories that no version names, of two
writers on one base the second is refused, and a reader keeps the version it began with.  Partitions that
a commit does not touch are named again and not rewritten.

The rename is atomic where the file system's is.  Versions list directories, so partitions should stay
in the thousands: ``rewrite`` of a partition puts those of many commits into one.
"""

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .model import RULES, STATEMENTS, TRANSACTIONS

CARDS = "id string, bank_id string, card_number_masked string, cardholder string, currency string, is_active boolean"
ALIASES = "id string, merchant_id string, alias_text string, normalized string, source string, confidence double"
MERCHANTS = "id string, name string, default_category_id string, is_active boolean"
REJECTED = "doc_id string, error string"
BUCKETS = 64


@dataclass(frozen=True)
class Table:
    """A schema, and a partition column with what it is computed from."""

    schema: str
    partition: str | None = None
    by: Callable[[], Column] | None = None


def bucket_of(*columns: str) -> Callable[[], Column]:
    return lambda: F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("string")


LEDGER = {
    "transactions": Table(TRANSACTIONS, "year_month", lambda: F.date_format("date", "yyyy-MM")),
    "statements": Table(STATEMENTS, "bucket", bucket_of("file_hash")),
    "rules": Table(RULES, "bucket", bucket_of("id")),
    "cards": Table(CARDS), "aliases": Table(ALIASES), "merchants": Table(MERCHANTS), "rejected": Table(REJECTED),
}


class Conflict(RuntimeError):
    """Another writer has committed since the base was read."""


@dataclass(frozen=True)
class Change:
    """Rows to add, after all rows of some partitions (of all, if there are no partitions) are gone where replaces is given."""

    rows: DataFrame
    replaces: tuple[str, ...] | None = field(default=None)


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table] = LEDGER):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.root, *parts)))

    def _files(self, path):
        fs = path.getFileSystem(self._conf)
        return fs, ([f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else [])

    def version(self) -> int:
        """The last version; 0 before the first commit."""
        _, files = self._files(self._path("versions"))
        return max((int(f.getName()) for f in files if f.getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        number = self.version() if version is None else version
        if not number:
            return {"version": 0, "tables": {}, "runs": {}}
        path = self._path("versions", str(number))
        stream = path.getFileSystem(self._conf).open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, with its partition column, which predicates prune."""
        table, dirs = self.tables[name], self.manifest(version)["tables"].get(name, [])
        schema = StructType.fromDDL(table.schema)
        full = StructType(schema.fields) if table.partition is None else StructType(schema.fields).add(table.partition, StringType())
        if not dirs:
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(StructType(full.fields).add("commit", StringType())).option("basePath", f"{self.root}/{name}")
        return rows.parquet(*(f"{self.root}/{name}/{d}" for d in dirs)).drop("commit")

    def _write(self, name: str, rows: DataFrame, commit: str) -> list[str]:
        """Directories of the rows, relative to the table's."""
        table, at = self.tables[name], f"{self.root}/{name}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(table.schema)]
        out = rows.select(*columns).withColumn("commit", F.lit(commit))
        if table.partition:
            out = out.withColumn(table.partition, table.by())
        out.write.mode("append").partitionBy(*([table.partition] if table.partition else []), "commit").parquet(at)
        pattern = self._path(name, *(["*"] if table.partition else []), f"commit={commit}")
        found = pattern.getFileSystem(self._conf).globStatus(pattern) or []
        return sorted("/".join(str(f.getPath()).split("/")[-2 if table.partition else -1 :]) for f in found)

    def commit(self, base: int, changes: dict[str, Change], run: tuple[str, int] | None = None) -> int:
        """The version after changes to one or more tables of a base; run (writer, number) is kept, so a stream can tell what it has committed."""
        before, commit = self.manifest(base), uuid.uuid4().hex
        tables = dict(before["tables"])
        for name, change in changes.items():
            column, old = self.tables[name].partition, tables.get(name, [])
            if change.replaces is not None:
                gone = {f"{column}={v}" for v in change.replaces}
                old = [d for d in old if column and d.split("/")[0] not in gone]
            tables[name] = old + self._write(name, change.rows, commit)
        after = {"version": base + 1, "tables": tables, "runs": before["runs"] | ({run[0]: run[1]} if run else {})}
        self._publish(base + 1, json.dumps(after))
        return base + 1

    def _publish(self, number: int, text: str) -> None:
        draft, final = self._path("versions", f".draft-{uuid.uuid4().hex}"), self._path("versions", str(number))
        fs = draft.getFileSystem(self._conf)
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        kind = getattr(self._hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self._hadoop.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, final, options)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {number} is there already") from None
            raise

    def committed(self, writer: str) -> int:
        """The last run of a writer; -1 before its first."""
        return self.manifest()["runs"].get(writer, -1)

    def partitions_of(self, name: str, keys: DataFrame, key: str = "id", version: int | None = None) -> tuple[str, ...]:
        """Partitions with rows of some keys: as many values as there are partitions at most."""
        column = self.tables[name].partition
        found = self.read(name, version).select(key, column).join(keys.select(key), key, "left_semi").select(column).distinct()
        return tuple(r[0] for r in found.collect())

    def rewrite(self, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], key: str = "id", base: int | None = None) -> int:
        """Commits change of the partitions that hold rows of some keys; a row must stay in its partition.  Without such rows nothing is committed."""
        base = self.version() if base is None else base
        column, touched = self.tables[name].partition, self.partitions_of(name, keys, key, base)
        if not touched:
            return base
        rows = self.read(name, base).where(F.col(column).isin(list(touched)))
        return self.commit(base, {name: Change(change(rows), touched)})

    def expire(self, keep: int = 10) -> int:
        """Deletes what only versions before the last ``keep`` name; returns how many directories went.  Not while a writer is at work."""
        last = self.version()
        fs, files = self._files(self._path("versions"))
        old = [int(f.getName()) for f in files if f.getName().isdigit() and int(f.getName()) <= last - keep]
        named = lambda versions: {f"{t}/{d}" for v in versions for t, dirs in self.manifest(v)["tables"].items() for d in dirs}
        gone = named(old) - named(range(max(1, last - keep + 1), last + 1))
        for d in sorted(gone):
            fs.delete(self._path(d), True)
        for v in old:
            fs.delete(self._path("versions", str(v)), False)
        return len(gone)
