"""Dashboard questions as single plans."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.period import Selection, add_months, month_bounds
from ..functions.text import percent_change
from ..operators.filters import by_month, card_filter
from ..operators.rollups import MONEY, top_category, top_merchant


def _of_card(tx: DataFrame, selection: Selection, statements: DataFrame | None) -> DataFrame:
    """Postings of the selected card, by its statements or by a column of their own."""
    if statements is not None or selection.card == "all":
        return card_filter(tx, statements, selection.card)
    return tx.where(F.col("card_id") == selection.card)


class _Parts:
    """The days a selection asks about, and sums over them from one scan: its window, its month, and the month before."""

    def __init__(self, selection: Selection, earliest: date | None):
        self.month = month_bounds(selection.period)
        self.prior = month_bounds(add_months(selection.period, -1))
        start, end = selection.window(earliest)
        # all time without an earliest day has no first day
        self.window = (None if selection.mode == "all_time" and earliest is None else start, end)
        self.days = (self.month[1] - self.month[0]).days + 1

    def rows(self, tx: DataFrame) -> DataFrame:
        start, end = self.window
        return by_month(tx, None if start is None else min(start, self.prior[0]), max(end, self.month[1]))

    def _within(self, days, value):
        start, end = days
        inside = F.col("date") <= F.lit(end)
        return F.when(inside if start is None else inside & (F.col("date") >= F.lit(start)), value)

    def sums(self):
        total = lambda days: F.sum(self._within(days, F.col("amount"))).cast(MONEY)
        n = F.count(self._within(self.window, F.lit(1)))
        return total(self.window).alias("total"), n.alias("txn_count"), total(self.month).alias("month_total"), total(self.prior).alias("prior_total")

    def daily(self):
        return F.bround(F.col("total") / self.days, 2).cast(MONEY)


def summary(tx: DataFrame, selection: Selection, earliest: date | None = None, statements: DataFrame | None = None) -> DataFrame:
    """Per currency: total and count of the window, mean per day of the month, month and prior month with their change, from one scan.

    A card is selected by its statements, or by tx's card_id where they are not given.
    """
    parts = _Parts(selection, earliest)
    got = parts.rows(_of_card(tx, selection, statements)).groupBy("currency").agg(*parts.sums())
    return got.select(
        F.lit(parts.month[0]).alias("period_start"), F.lit(parts.window[1]).alias("period_end"), "currency", "total", "txn_count", parts.daily().alias("daily_avg"), "month_total", "prior_total",
        percent_change(F.col("month_total"), F.col("prior_total")).alias("change_pct"),
    ).where("txn_count > 0")


def overview(tx: DataFrame, selection: Selection, categories: DataFrame, merchants: DataFrame, earliest: date | None = None, statements: DataFrame | None = None) -> DataFrame:
    """The summary, with the totals of the top category and the top merchant, from one scan of the postings.

    Grouping sets give totals by currency, by category and by merchant.  kind is currency, category or merchant; entity and name are
    those of the top one (of equals the first in order, or by name); means per day and change are the currencies' own.
    """
    parts = _Parts(selection, earliest)
    rows = parts.rows(_of_card(tx, selection, statements)).select("date", "amount", "currency", "category_id", "merchant_id")
    kind = F.when(F.grouping("category_id") == 0, "category").when(F.grouping("merchant_id") == 0, "merchant").otherwise("currency")
    sets = [["currency"], ["category_id", "currency"], ["merchant_id", "currency"]]
    got = rows.groupingSets(sets, "currency", "category_id", "merchant_id").agg(*parts.sums(), kind.alias("kind")).where("txn_count > 0")
    got = got.withColumn("entity", F.coalesce(F.col("category_id").cast("string"), F.col("merchant_id").cast("string"))).where("kind = 'currency' or entity is not null")
    known = categories.select(F.lit("category").alias("kind"), F.col("id").cast("string").alias("entity"), "name", "sort_order")
    named = merchants.select(F.lit("merchant").alias("kind"), F.col("id").cast("string").alias("entity"), "name", F.lit(0).alias("sort_order"))
    full = got.drop("category_id", "merchant_id").join(known.unionByName(named), ["kind", "entity"], "left").where("kind <> 'category' or sort_order is not null")
    full = full.withColumn("name", F.when(F.col("kind") == "merchant", F.coalesce("name", F.lit(""))).otherwise(F.col("name")))
    # an entity has as many rows as there are currencies; each kind's first is found as its partial results are merged
    shown = F.struct("currency", "total", "txn_count", "month_total", "prior_total")
    per = full.groupBy("kind", "entity", "name", "sort_order").agg(F.max("total").alias("_most"), F.collect_list(shown).alias("rows"))
    order = F.struct((-F.col("_most")).alias("a"), F.coalesce("sort_order", F.lit(0)).alias("b"), F.when(F.col("kind") == "merchant", F.col("name")).alias("c"), F.col("entity").alias("d"))
    tops = per.groupBy("kind").agg(F.min_by(F.struct("entity", "name", "rows"), order).alias("top"))
    flat = tops.select("kind", "top.entity", "top.name", F.explode("top.rows").alias("r")).select("kind", "entity", "name", "r.*")
    own = F.col("kind") == "currency"
    return flat.select(
        "kind", "entity", "name", "currency", "total", "txn_count", F.when(own, parts.daily()).alias("daily_avg"), F.when(own, F.col("month_total")).alias("month_total"), F.when(own, F.col("prior_total")).alias("prior_total"),
        F.when(own, percent_change(F.col("month_total"), F.col("prior_total"))).alias("change_pct"),
    )


def highlights(tx: DataFrame, selection: Selection, categories: DataFrame, merchants: DataFrame, earliest: date | None = None, statements: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The window's top category and top merchant; no rows where there is nothing."""
    start, end = _Parts(selection, earliest).window
    rows = by_month(_of_card(tx, selection, statements), start, end)
    return top_category(rows, categories), top_merchant(rows, merchants)


def totals_map(totals: DataFrame, *keys) -> DataFrame:
    """Totals as a map from currency, for presentation."""
    return totals.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("currency", "total")))).alias("totals"))
