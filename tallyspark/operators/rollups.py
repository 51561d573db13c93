"""Aggregations per currency.  Currencies are never added up."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.period import validate

MONEY = "decimal(25,2)"


def total():
    return F.sum("amount").cast(MONEY).alias("total")


def totals_by_currency(tx: DataFrame) -> DataFrame:
    return tx.groupBy("currency").agg(total(), F.count("*").alias("txn_count"))


def earliest_date(tx: DataFrame) -> DataFrame:
    return tx.agg(F.min("date").alias("earliest"))


def transaction_count(tx: DataFrame) -> DataFrame:
    return tx.agg(F.count("*").alias("n"))


def distinct_months(tx: DataFrame) -> DataFrame:
    return tx.select(F.date_format("date", "yyyy-MM").alias("month")).distinct().orderBy("month")


def entity_rollup(tx: DataFrame, entity: str) -> DataFrame:
    """entity, currency, total, txn_count, last_seen of rows that name an entity."""
    return tx.where(F.col(entity).isNotNull()).groupBy(entity, "currency").agg(total(), F.count("*").alias("txn_count"), F.max("date").alias("last_seen"))


def category_currency_rollup(tx: DataFrame) -> DataFrame:
    return entity_rollup(tx, "category_id").drop("last_seen")


def _top(rollup: DataFrame, entity: str, *ties) -> DataFrame:
    best = rollup.groupBy(entity, *ties).agg(F.max("total").alias("_max")).orderBy(F.desc("_max"), *ties, entity).limit(1).select(entity)
    return rollup.join(best, entity, "left_semi")


def top_category(tx: DataFrame, categories: DataFrame) -> DataFrame:
    """The totals of the category with the largest total in one currency; of equals the first in order."""
    named = entity_rollup(tx, "category_id").join(F.broadcast(categories.select(F.col("id").alias("category_id"), "sort_order")), "category_id")
    return _top(named, "category_id", "sort_order").select("category_id", "currency", "total")


def top_merchant(tx: DataFrame, merchants: DataFrame) -> DataFrame:
    named = with_merchant_name(entity_rollup(tx, "merchant_id"), merchants, "")
    return _top(named, "merchant_id", "merchant_name").select("merchant_id", "merchant_name", "currency", "total")


def with_merchant_name(rows: DataFrame, merchants: DataFrame, missing: str = "<unknown>") -> DataFrame:
    names = merchants.select(F.col("id").alias("merchant_id"), F.col("name").alias("merchant_name"))
    return rows.join(names, "merchant_id", "left").withColumn("merchant_name", F.coalesce("merchant_name", F.lit(missing)))


def merchant_breakdown(tx: DataFrame, merchants: DataFrame, limit: int = 10) -> DataFrame:
    """Totals per currency of the merchants with the largest totals in one currency, with their count and last day over all currencies; 1 to 50 merchants."""
    validate(merchants=limit)
    rollup = entity_rollup(tx, "merchant_id")
    per = rollup.groupBy("merchant_id").agg(F.max("total").alias("max_total"), F.sum("txn_count").alias("count_all"), F.max("last_seen").alias("last_seen"))
    top = top_n_merchants(with_merchant_name(per, merchants), limit)
    return rollup.select("merchant_id", "currency", "total").join(top, "merchant_id").orderBy(F.desc("max_total"), "merchant_name", "merchant_id", "currency")


def top_n_merchants(rollup: DataFrame, n: int) -> DataFrame:
    return rollup.orderBy(F.desc("max_total"), "merchant_name", "merchant_id").limit(n)


def category_breakdown(tx: DataFrame, categories: DataFrame) -> DataFrame:
    """Every category by currency, with its dominant currency and that currency's share of the period's total."""
    rollup = category_currency_rollup(tx)
    whole = totals_by_currency(tx).select(F.col("currency").alias("dominant_currency"), F.col("total").alias("period_total"))
    per = rollup.groupBy("category_id").agg(F.min(F.struct((-F.abs("total")).alias("a"), "currency", "total")).alias("d"), F.max("total").alias("max_total"))
    per = per.select("category_id", F.col("d.currency").alias("dominant_currency"), F.col("d.total").alias("dominant_total"), "max_total").join(whole, "dominant_currency", "left")
    raw = F.when(F.col("period_total") > 0, F.col("dominant_total").cast("double") / F.col("period_total").cast("double")).otherwise(0.0)
    c = categories.select(F.col("id").alias("category_id"), "name", "sort_order")
    out = c.join(rollup, "category_id", "left").join(per, "category_id", "left").withColumn("pct", F.round(raw, 4))
    out = out.withColumn("pct_valid", F.col("pct").between(0.0, 1.0)).withColumn("txn_count", F.coalesce("txn_count", F.lit(0)))
    return order_categories(out.select("category_id", "name", "sort_order", "currency", "total", "txn_count", "dominant_currency", "pct", "pct_valid", "max_total"))


def order_categories(rollup: DataFrame) -> DataFrame:
    return rollup.orderBy(F.coalesce("max_total", F.lit(0)).desc(), "sort_order", "currency")


def monthly_totals(tx: DataFrame) -> DataFrame:
    return tx.groupBy(F.date_format("date", "yyyy-MM").alias("month"), "currency").agg(total())


def spine(spark, start: date, end: date) -> DataFrame:
    months = F.explode(F.sequence(F.trunc(F.lit(start), "MM"), F.trunc(F.lit(end), "MM"), F.expr("interval 1 month")))
    return spark.range(1).select(months.alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))


def monthly(tx: DataFrame, months: int, as_of: date) -> DataFrame:
    """month, currency, total and prev_pct of the last months up to as_of's, gaps as rows without a currency; of 0 months, of all that have rows."""
    from .windows import with_prev_pct

    series = monthly_totals(tx)
    if months:
        from ..functions.period import add_months

        return monthly_window(tx, add_months(as_of, 1 - months), as_of)
    return with_prev_pct(series)


def monthly_window(tx: DataFrame, start: date, end: date) -> DataFrame:
    """One aggregation over the window's rows, laid on a spine of its months."""
    from .windows import prev_pct

    series = monthly_totals(tx.where(F.col("date").between(F.trunc(F.lit(start), "MM"), F.last_day(F.lit(end)))))
    axis = spine(tx.sparkSession, start, end)
    before = F.date_format(F.add_months(F.to_date("month", "yyyy-MM"), -1), "yyyy-MM")
    held = prev_pct(series, "month", before, "month").where("currency is not null and total is not null")
    return axis.join(held, "month", "left").orderBy("month", "currency")
