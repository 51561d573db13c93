"""Merchants, their aliases and categories."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alias_key, normalize_merchant, surrogate_key
from ..sources.model import CATEGORY_ALIASES, KNOWN_MERCHANTS


def with_canonical(tx: DataFrame, text: str = "description") -> DataFrame:
    """canonical, computed once for each distinct description; only those with other than ASCII letters are decomposed in Python."""
    keys = tx.select(text).distinct()
    plain = ~F.coalesce(F.col(text).rlike(r"[^\x00-\x7F]"), F.lit(False))
    keys = keys.where(plain).withColumn("canonical", normalize_merchant(F.col(text))).unionByName(keys.where(~plain).withColumn("canonical", normalize_merchant(F.col(text), exact=True)))
    return tx.join(keys, text, "left")


def one_alias_each(aliases: DataFrame) -> DataFrame:
    """One alias for each normalized text: a user's before a model's before an automatic one, then the newest id, then by text."""
    rank = F.when(F.col("source") == "user", 0).when(F.col("source") == "llm", 1).otherwise(2)
    w = Window.partitionBy("normalized").orderBy(rank, F.desc("id"), "alias_text")
    return aliases.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def match_aliases(tx: DataFrame, aliases: DataFrame) -> DataFrame:
    """tx (with canonical) with merchant_id of the alias it meets, or null."""
    a = one_alias_each(aliases).select(F.col("normalized").alias("canonical"), F.col("merchant_id").alias("_m"))
    return tx.join(a, "canonical", "left").withColumn("merchant_id", F.col("_m")).drop("_m")


def known_category(tx: DataFrame) -> DataFrame:
    """tx with known_category: the category of a canonical name that is a known merchant's exactly."""
    known = tx.sparkSession.createDataFrame(list(KNOWN_MERCHANTS), "canonical string, known_category string")
    return tx.join(F.broadcast(known), "canonical", "left")


def resolve_categories(tx: DataFrame, categories: DataFrame, text: str = "category") -> DataFrame:
    """category_id and category_label by the category's name, whatever its case; an unknown label stays, a null one is Uncategorized."""
    c = categories.select(F.lower(F.trim("name")).alias("_key"), F.col("id").alias("category_id"), F.col("name").alias("_name"))
    out = tx.drop("category_id").join(F.broadcast(c), F.lower(F.trim(F.col(text))) == F.col("_key"), "left")
    return out.withColumn("category_label", F.coalesce("_name", text, F.lit("Uncategorized"))).drop("_key", "_name")


def category_alias(tx: DataFrame, text: str) -> DataFrame:
    """canonical_category by a table of other names; Uncategorized where there is none."""
    names = tx.sparkSession.createDataFrame(list(CATEGORY_ALIASES), "_key string, canonical_category string")
    out = tx.withColumn("_key", alias_key(F.col(text))).join(F.broadcast(names), "_key", "left").drop("_key")
    return out.withColumn("canonical_category", F.coalesce("canonical_category", F.lit("Uncategorized")))


def low_confidence(category_hit, alias_hit, default_category):
    return ~category_hit | (~alias_hit & default_category.isNull())


def resolve_merchants(tx: DataFrame, aliases: DataFrame, merchants: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tx with merchant_id and alias_hit, and the aliases and merchants after it: an unknown canonical name makes one of each, with the same ids however often it runs."""
    out, added, made = new_merchants(tx, aliases, merchants, categories)
    return out, aliases.unionByName(added), merchants.unionByName(made)


def new_merchants(tx: DataFrame, aliases: DataFrame, merchants: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tx with merchant_id and alias_hit, and only the aliases and merchants that it makes."""
    hit = match_aliases(with_canonical(tx), aliases).withColumn("alias_hit", F.col("merchant_id").isNotNull())
    fresh = hit.where("merchant_id is null and canonical <> ''").groupBy("canonical").agg(F.min("description").alias("alias_text"))
    new = known_category(fresh.withColumn("merchant_id", surrogate_key(F.lit("merchant"), "canonical")))
    c = categories.select(F.col("name").alias("known_category"), F.col("id").alias("default_category_id"))
    new = new.join(F.broadcast(c), "known_category", "left")
    made = new.select(F.col("merchant_id").alias("id"), F.col("canonical").alias("name"), "default_category_id", F.lit(True).alias("is_active"))
    made = made.join(merchants, "id", "left_anti")
    added = new.select(surrogate_key(F.lit("alias"), "canonical").alias("id"), "merchant_id", "alias_text", F.col("canonical").alias("normalized"), F.lit("auto").alias("source"), F.lit(1.0).alias("confidence"))
    ids = new.select("canonical", F.col("merchant_id").alias("_new"))
    out = hit.join(ids, "canonical", "left").withColumn("merchant_id", F.coalesce("merchant_id", "_new")).drop("_new")
    return out, added.join(aliases, "id", "left_anti"), made


def bind_suggestions(suggestions: DataFrame, merchants: DataFrame) -> DataFrame:
    """suggestions(raw, suggestion) with the merchant whose name it normalises to, or a new one's id."""
    s = suggestions.withColumn("name", normalize_merchant(F.col("suggestion")))
    m = merchants.groupBy("name").agg(F.min("id").alias("merchant_id"))
    return s.join(m, "name", "left").withColumn("is_new", F.col("merchant_id").isNull()).withColumn("merchant_id", F.coalesce("merchant_id", surrogate_key(F.lit("merchant"), "name")))


def add_aliases(aliases: DataFrame, merchants: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """aliases with new(merchant_id, alias_text) added, and the rejected ones with their reason."""
    w = Window.partitionBy("alias_text").orderBy("merchant_id")
    known = merchants.select(F.col("id").alias("merchant_id"), F.lit(True).alias("_known"))
    taken = aliases.select("alias_text", F.lit(True).alias("_taken")).distinct()
    checked = new.withColumn("_n", F.row_number().over(w)).join(known, "merchant_id", "left").join(taken, "alias_text", "left")
    reason = F.when(F.coalesce(F.trim("alias_text"), F.lit("")) == "", "blank").when(F.col("_taken") | (F.col("_n") > 1), "duplicate").when(F.col("_known").isNull(), "unknown merchant")
    checked = checked.withColumn("reason", reason)
    good = checked.where("reason is null").select(surrogate_key(F.lit("alias"), "alias_text").alias("id"), "merchant_id", "alias_text", normalize_merchant(F.col("alias_text")).alias("normalized"), F.lit("user").alias("source"), F.lit(1.0).alias("confidence"))
    return aliases.unionByName(good), checked.where("reason is not null").select("merchant_id", "alias_text", "reason")
