"""Filters, orders and pages of transactions."""

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.period import month_bounds, validate


def by_month(tx: DataFrame, date_from: date | None = None, date_to: date | None = None, partition: str = "year_month") -> DataFrame:
    """tx between two days; where it is partitioned by month, other months' files are not read."""
    if date_from is not None:
        tx = tx.where(F.col("date") >= F.lit(date_from))
        tx = tx.where(F.col(partition) >= f"{date_from:%Y-%m}") if partition in tx.columns else tx
    if date_to is not None:
        tx = tx.where(F.col("date") <= F.lit(date_to))
        tx = tx.where(F.col(partition) <= f"{date_to:%Y-%m}") if partition in tx.columns else tx
    return tx


def in_months_of(tx: DataFrame, bounds: DataFrame, start: str = "start", end: str = "end", partition: str = "year_month") -> DataFrame:
    """tx of the months that some row of bounds(start, end) reaches into, for bounds that a table gives: the months, few as they are, prune tx's partitions when the query runs."""
    if partition not in tx.columns:
        return tx
    # bounds that are turned round hold no day; the comparison also is what makes Spark prune
    months = bounds.where(F.col(start) <= F.col(end)).select(F.explode(F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))).alias("_month")).select(F.date_format("_month", "yyyy-MM").alias(partition)).distinct()
    return tx.join(F.broadcast(months), partition, "left_semi")


def filter_transactions(tx: DataFrame, statement=None, date_from: date | None = None, date_to: date | None = None, amount_min=None, amount_max=None, contains: str | None = None, currency: str | None = None, categories=None, uncategorized: bool = False) -> DataFrame:
    """Rows that meet all criteria given.  Amounts compare by size, so refunds match; % and _ in contains are wildcards; a category and uncategorized are alternatives."""
    if statement is not None:
        tx = tx.where(F.col("statement_id") == statement)
    tx = by_month(tx, date_from, date_to)
    if amount_min is not None:
        tx = tx.where(F.abs("amount") >= amount_min)
    if amount_max is not None:
        tx = tx.where(F.abs("amount") <= amount_max)
    if contains:
        tx = tx.where(F.lower("description").like(f"%{contains.lower()}%"))
    if currency:
        tx = tx.where(F.col("currency") == currency)
    either = ([F.col("category_id").isin(list(categories))] if categories else []) + ([F.col("category_id").isNull() | F.col("low_confidence")] if uncategorized else [])
    return tx.where(reduce(lambda a, b: a | b, either)) if either else tx


def card_filter(tx: DataFrame, statements: DataFrame, card) -> DataFrame:
    """Transactions of a card's statements; "all" needs no join."""
    if card == "all":
        return tx
    own = statements.where(F.col("credit_card_id") == card).select(F.col("id").alias("statement_id"))
    return tx.join(own, "statement_id", "left_semi")


def month_filter(tx: DataFrame, period: date) -> DataFrame:
    return by_month(tx, *month_bounds(period))


def window_filter(tx: DataFrame, start: date, end: date) -> DataFrame:
    return by_month(tx, start, end)


def active(rows: DataFrame) -> DataFrame:
    return rows.where("is_active")


def page(tx: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    validate(limit=limit, offset=offset)
    return tx.orderBy("date", "id").offset(offset).limit(limit)


def list_banks(banks: DataFrame) -> DataFrame:
    return active(banks).orderBy("display_name")


def list_categories(categories: DataFrame) -> DataFrame:
    return categories.orderBy("sort_order")


def list_merchants(merchants: DataFrame) -> DataFrame:
    return merchants.orderBy("name")


def list_cards(cards: DataFrame) -> DataFrame:
    return active(cards).orderBy("bank_id", "card_number_masked")


def list_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("last_seen_date"), "id")


def card_labels(cards: DataFrame, banks: DataFrame) -> DataFrame:
    """Cards with a label of their bank's name and mask."""
    b = banks.select(F.col("id").alias("bank_id"), F.col("display_name").alias("bank_name"))
    return cards.join(b, "bank_id").withColumn("label", F.concat_ws(" - ", "bank_name", "card_number_masked"))
