"""Helpers that add one column by a window."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = ("card_id", "merchant_id", "currency")


def with_prev_pct(series: DataFrame, month: str = "month") -> DataFrame:
    """prev_pct: change of total against the series' previous entry, per currency; null where that was nothing.  The first entry has none.

    Months are numbered over all currencies, so a currency's row before it counts only if it is of the month before; the
    series, one row for each month and currency, is read once.
    """
    placed = series.where(F.col(month).isNotNull()).withColumn("_place", F.dense_rank().over(Window.orderBy(month)))
    return prev_pct(placed, month, F.col("_place") - 1, "_place").drop("_place").where("currency is not null and total is not null")


def prev_pct(series: DataFrame, month: str, before, place: str) -> DataFrame:
    """prev_pct against the row whose place is before, if that is the one ahead in order of month."""
    w = Window.partitionBy("currency").orderBy(month)
    last = F.when(F.lag(place).over(w) == before, F.lag("total").over(w))
    return series.withColumn("prev_pct", F.when(last != 0, F.round(((F.col("total") - last) / last * 100).cast("double"), 1)))


def with_gap_days(tx: DataFrame, group=GROUP) -> DataFrame:
    w = Window.partitionBy(*group).orderBy("date", "id")
    return tx.withColumn("gap_days", F.datediff("date", F.lag("date").over(w)))


def group_medians(tx: DataFrame, group=GROUP, times: str | None = None) -> DataFrame:
    """group and the exact median of amount, from counted values: no task holds a group's rows.  A row counts as often as its column times says.

    Values of a group are counted where they are; then counts per leading digits (two of them, sign and power of ten) say which digits the
    middle ones have, and only values with those digits are ranked.  Nulls do not count.
    """
    size = F.abs("amount").cast("double")
    power = F.floor(F.log10(size))
    digits = F.when(F.col("amount") == 0, 0).otherwise(F.signum(F.col("amount").cast("double")) * (1000 + power * 100 + F.floor(size / F.pow(F.lit(10.0), power) * 10))).cast("long")
    values = tx.where("amount is not null").groupBy(*group, "amount").agg((F.sum(times) if times else F.count("*")).alias("_n")).withColumn("_digits", digits)
    counts = values.groupBy(*group, "_digits").agg(F.sum("_n").alias("_in"), F.min("amount").alias("_least"))
    whole = Window.partitionBy(*group)
    up_to = F.sum("_in").over(whole.orderBy("_least"))
    n = F.sum("_in").over(whole)
    # places of the two middle rows, from 1
    low, high = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    met = counts.select(*group, "_digits", (up_to - F.col("_in")).alias("_before"), low.alias("_low"), high.alias("_high"), up_to.alias("_up_to"))
    met = met.where("_before < _high and _up_to >= _low").select(*group, "_digits", "_before", "_low", "_high")
    same = values.alias("v").join(met.alias("m"), [F.col(f"v.{c}").eqNullSafe(F.col(f"m.{c}")) for c in (*group, "_digits")])
    near = same.select(*(F.col(f"v.{c}").alias(c) for c in (*group, "_digits", "amount", "_n")), "_before", "_low", "_high")
    last = F.col("_before") + F.sum("_n").over(Window.partitionBy(*group, "_digits").orderBy("amount"))
    ranked = near.withColumn("_last", last).where((F.col("_last") >= F.col("_low")) & (F.col("_last") - F.col("_n") < F.col("_high")))
    middle = (F.min("amount") + F.max("amount")) / 2
    return ranked.groupBy(*group).agg(middle.cast("decimal(18,3)").alias("median"))


def with_group_median(tx: DataFrame, group=GROUP, times: str | None = None) -> DataFrame:
    """tx with the median of its group, which is joined to the rows where they are."""
    medians = group_medians(tx, group, times).select(*(F.col(c).alias(f"_{c}") for c in group), "median")
    return tx.join(medians, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group], "left").drop(*(f"_{c}" for c in group))


def dedupe_extracted(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The first of a document's rows with the same date, description and amount as written."""
    w = Window.partitionBy(doc, "date", F.upper(F.trim("description")), F.trim("amount")).orderBy("chunk_idx", "pos")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def surviving_rules(rules: DataFrame) -> DataFrame:
    w = Window.partitionBy("merchant_id", "amount_min", "amount_max", "currency", "period_days").orderBy(F.desc("confidence"), F.desc("last_seen_date"), "id")
    return rules.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_bar_width(series: DataFrame) -> DataFrame:
    top = F.max("total").over(Window.partitionBy("currency"))
    return series.withColumn("bar_width", F.when((top > 0) & F.col("total").isNotNull(), F.bround(F.col("total") / top * 100, 1).cast("double")).otherwise(0.0))


def with_statement_error(rows: DataFrame, statement: str = "statement_id", error: str = "row_error") -> DataFrame:
    return rows.withColumn("statement_error", F.max(error).over(Window.partitionBy(statement)))


def with_slot(plan: DataFrame, order: str = "date") -> DataFrame:
    """slot: number of a row within its month and currency by date and order, from 0; slot_date: the day it is posted on.

    Rows are numbered within their day, after the counted rows of the days before.
    """
    day = [F.trunc("date", "MM").alias("_month"), F.col("currency").alias("_currency"), F.col("date").alias("_date")]
    counted = plan.groupBy(*day).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_month", "_currency").orderBy("_date").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("_currency", "_date", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    own = plan.withColumn("_own", F.row_number().over(Window.partitionBy("date", "currency").orderBy(order)))
    same = own["date"].eqNullSafe(before["_date"]) & own["currency"].eqNullSafe(before["_currency"])
    slotted = own.join(before, same).withColumn("slot", F.col("_before") + F.col("_own") - 1).drop("_own", "_before", "_date", "_currency")
    day = F.least(F.col("slot") * 3 + 2, F.dayofmonth(F.last_day("date")))
    return slotted.withColumn("slot_date", F.make_date(F.year("date"), F.month("date"), day))
