"""Tables cut from their lineage, in the folder that the cluster shares."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode and an error on a cluster."""
    sc = spark.sparkContext
    if at := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return at
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def write(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: a lost executor costs no recomputation of what led to it."""
    return write(df)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of write() that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def row_of(columns, name: str = "row"):
    """The columns as one struct, whatever their names hold."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in columns)).alias(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
