"""Edits of tables: a snapshot and a table of edits give the next snapshot."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_category_edits(tx: DataFrame, edits: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edits: id, action (set, clear or text), category_id, label; one for each transaction.  The next transactions, and the rejected edits with a reason."""
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("_name"))
    known = tx.select("id", F.lit(True).alias("_known"))
    e = edits.join(c, "category_id", "left").join(known, "id", "left")
    reason = (
        F.when(F.col("_known").isNull(), "unknown transaction")
        .when((F.col("action") == "set") & F.col("_name").isNull(), "unknown category")
        .when((F.col("action") == "text") & (F.coalesce(F.trim("label"), F.lit("")) == ""), "nothing to set")
        .when(~F.coalesce(F.col("action").isin("set", "clear", "text"), F.lit(False)), "nothing to set")
    )
    e = e.withColumn("reason", reason)
    good = e.where("reason is null").select("id", F.col("action").alias("_a"), F.col("category_id").alias("_c"), F.when(F.col("action") == "set", F.col("_name")).when(F.col("action") == "text", F.col("label")).alias("_l"))
    out = tx.join(good, "id", "left")
    out = out.withColumn("category_id", F.when(F.col("_a").isNull(), F.col("category_id")).when(F.col("_a") == "set", F.col("_c")))
    out = out.withColumn("category", F.when(F.col("_a").isNull(), F.col("category")).otherwise(F.col("_l")))
    out = out.withColumn("low_confidence", F.when(F.col("_a").isNull(), F.col("low_confidence")).otherwise(F.col("_a") != "set"))
    return out.drop("_a", "_c", "_l"), e.where("reason is not null").select("id", "action", "reason")


def rename_categories(categories: DataFrame, tx: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """renames: id, name.  The next categories and transactions, and the rejected renames, whose name another category has in any case."""
    r = renames.withColumnRenamed("name", "_new")
    others = categories.select(F.col("id").alias("_other"), F.lower("name").alias("_taken"))
    clash = r.join(others, (F.lower("_new") == F.col("_taken")) & (F.col("id") != F.col("_other"))).select("id").distinct()
    good = r.join(clash, "id", "left_anti")
    after = categories.join(good, "id", "left").withColumn("name", F.coalesce("_new", "name")).drop("_new")
    labels = good.select(F.col("id").alias("category_id"), "_new")
    moved = tx.join(labels, "category_id", "left").withColumn("category", F.coalesce("_new", "category")).drop("_new")
    return after, moved, r.join(clash, "id", "left_semi").withColumnRenamed("_new", "name")


def cascade_delete(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """children without those that refer to a deleted parent; gone: id."""
    return children.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def set_null(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    g = gone.select(F.col("id").alias(key), F.lit(True).alias("_gone")).distinct()
    return children.join(g, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def check_unique(df: DataFrame, *columns: str) -> DataFrame:
    """The keys that more than one row has, and how many have them."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def check_fk(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Children whose reference leads nowhere."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def guarded_upsert(target: DataFrame, batch: DataFrame, key: str, marker: str, value: str) -> tuple[DataFrame, DataFrame]:
    """target with the batch's rows added or replaced where they carry the marker, and the batch's rows that meet a foreign row.  A caller writes only if there are none."""
    own = target.where(F.col(marker) == value)
    foreign = target.where(F.coalesce(F.col(marker), F.lit("")) != value)
    conflicts = batch.join(foreign.select(key), key, "left_semi")
    return foreign.unionByName(own.join(batch.select(key), key, "left_anti")).unionByName(batch.withColumn(marker, F.lit(value))), conflicts
