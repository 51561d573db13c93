"""Detection of recurring charges and the rules that keep them."""

import math
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.period import month_bounds
from ..functions.text import classify_period, surrogate_key
from ..sources.staging import staged
from .filters import active, by_month, list_rules
from .windows import GROUP

LOOKBACK_DAYS, BAND, LEAST = 90, "0.15", 3
#: The magnitude of amounts that have no logarithm.
NONE = -1_000_000
KEY = ("merchant_id", "amount_min", "amount_max", "currency", "period_days")


def detector_scan(tx: DataFrame, statements: DataFrame, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """Each card's postings since lookback days before the end of its newest statement, without instalments and unnamed merchants."""
    newest = statements.groupBy(F.col("credit_card_id").alias("card_id")).agg(F.max("period_end").alias("period_end"))
    if "year_month" in tx.columns:
        # the first month that any card needs, found when the query runs
        tx = tx.where(F.col("year_month") >= newest.agg(F.date_format(F.date_sub(F.min("period_end"), lookback), "yyyy-MM")).scalar())
    rows = tx.drop("period_end").where(F.col("installment_number").isNull() & F.col("merchant_id").isNotNull()).join(newest, "card_id")
    return rows.where(F.col("date") >= F.date_sub("period_end", lookback))


def in_band(amount, median):
    return amount.between(median * F.lit(1 - float(BAND)).cast("decimal(3,2)"), median * F.lit(1 + float(BAND)).cast("decimal(3,2)"))


def recurring_group_stats(scan: DataFrame, group=GROUP) -> DataFrame:
    """Groups of card, merchant and currency that recur: count, median of all, bounds and last day of those in band, days between.

    Postings are counted by day and amount first and ranked by amount within their group, where all that follows stays: one
    shuffle for the counts and one for the groups.  Those in band are counted by day before their gaps are taken.
    """
    counted = scan.where("amount is not null").groupBy(*group, "date", "amount").agg(F.count("*").alias("_n"))
    ranks = Window.partitionBy(*group).orderBy("amount")
    whole = ranks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = counted.withColumn("_up_to", F.sum("_n").over(ranks.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(whole)).where(F.col("_all") >= LEAST)
    # the smallest amount up to which there are so many
    at = lambda place: F.min(F.when(F.col("_up_to") >= place, F.col("amount"))).over(whole)
    middle = ((at(F.floor((F.col("_all") + 1) / 2)) + at(F.floor(F.col("_all") / 2) + 1)) / 2).cast("decimal(18,3)")
    banded = ranked.withColumn("median", middle).where(in_band(F.col("amount"), F.col("median")))
    days = banded.groupBy(*group, "date").agg(F.sum("_n").alias("_n"), F.max("median").alias("median"), F.min("amount").alias("_low"), F.max("amount").alias("_high"))
    order = Window.partitionBy(*group).orderBy("date")
    days = days.withColumn("_days", F.datediff("date", F.lag("date").over(order))).withColumn("_in", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    days = days.where(F.col("_in") >= LEAST)
    # one gap to the day before, and gaps of nothing between postings of one day: as many as its postings
    gaps = days.withColumn("_gap", F.explode(F.array(F.struct(F.col("_days").alias("days"), F.lit(1).cast("long").alias("times")), F.struct(F.lit(0).alias("days"), (F.col("_n") - 1).alias("times")))))
    stats = gaps.groupBy(*group).agg(
        F.sum("_gap.times").alias("n"), F.max("median").alias("median"), F.min("_low").alias("amount_min"), F.max("_high").alias("amount_max"), F.max("date").alias("last_seen_date"),
        F.bround(F.percentile(F.col("_gap.days"), 0.5, F.col("_gap.times")), 0).cast("int").alias("period_days"),
    )
    return stats.where((F.col("n") >= LEAST) & (F.col("period_days") > 0))


def confidence(n, low, high, median):
    spread = (high - low).cast("double") / median.cast("double")
    return F.when(median == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), n / 5) * F.greatest(F.lit(0.0), 1 - spread), 4))


def detect(tx: DataFrame, statements: DataFrame) -> DataFrame:
    """A rule for each group that recurs up to its card's newest statement."""
    stats = recurring_group_stats(detector_scan(tx, statements))
    return stats.withColumn("period_label", classify_period(F.col("period_days"))).withColumn("confidence", confidence(F.col("n"), F.col("amount_min"), F.col("amount_max"), F.col("median")))


def newest_statements(statements: DataFrame) -> DataFrame:
    """card_id, statement_id, period_end: the statement that each card's detection runs for."""
    last = F.max(F.struct("period_end", "id")).alias("_last")
    return statements.groupBy(F.col("credit_card_id").alias("card_id")).agg(last).select("card_id", F.col("_last.id").alias("statement_id"), F.col("_last.period_end").alias("period_end"))


def _of_detections(tx: DataFrame, statements: DataFrame, detected: DataFrame) -> DataFrame:
    """Postings of the newest statements, with its period_end, within the bounds of their card's detection of their merchant and currency, of which there is one."""
    found = detected.select("card_id", "merchant_id", "currency", *(F.col(c).alias(f"_{c}") for c in ("amount_min", "amount_max", "period_days")))
    own = tx.drop("period_end").join(newest_statements(statements), ["card_id", "statement_id"])
    return own.join(found, ["card_id", "merchant_id", "currency"]).where(F.col("amount").between(F.col("_amount_min"), F.col("_amount_max")))


def upsert_rules(rules: DataFrame, detected: DataFrame, tx: DataFrame, statements: DataFrame, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """Rules after a run of the detector: those met again are refreshed, others kept, new ones added as active.

    A new rule counts all postings of its detections; one met again adds those of the newest statements, of the
    lookback days, that are not linked to this very rule: a link to another one does not keep a posting out.  Of
    several detections on a key the last by (last_seen_date, card) gives day and label.
    """
    known = rules.select(*KEY, F.col("id").alias("_known"))
    own = _of_detections(tx.where(F.col("installment_number").isNull()), statements, detected).where(F.col("date") >= F.date_sub("period_end", lookback))
    own = own.join(known.select(*(F.col(c).alias(f"_{c}") if c in ("amount_min", "amount_max", "period_days") else F.col(c) for c in KEY), "_known"), ["merchant_id", "currency", "_amount_min", "_amount_max", "_period_days"])
    other = ~F.col("recurring_rule_id").eqNullSafe(F.col("_known")) if "recurring_rule_id" in tx.columns else F.lit(True)
    fresh = own.where(other).groupBy("card_id", "merchant_id", "currency").agg(F.count("*").alias("_fresh"))
    last = F.max_by(F.struct("period_label", "last_seen_date", "median"), F.struct("last_seen_date", "card_id"))
    met = detected.join(fresh, ["card_id", "merchant_id", "currency"], "left").groupBy(*KEY).agg(F.sum("n").alias("_all"), F.sum(F.coalesce("_fresh", F.lit(0))).alias("_fresh"), last.alias("_last"))
    met = met.join(known, list(KEY), "left")
    return _merged(rules, met.select(*KEY, F.col("_last.period_label").alias("_label"), F.col("_last.last_seen_date").alias("_seen"), F.when(F.col("_known").isNotNull(), F.col("_fresh")).otherwise(F.col("_all")).alias("new"), F.col("_last.median").alias("median")))


def _merged(rules: DataFrame, met: DataFrame) -> DataFrame:
    both = rules.join(met, list(KEY), "full_outer")
    n = F.coalesce("occurrences", F.lit(0)) + F.coalesce("new", F.lit(0))
    again = confidence(n, F.col("amount_min"), F.col("amount_max"), F.col("median"))
    return both.select(
        F.coalesce("id", surrogate_key(*KEY)).alias("id"), *KEY, F.coalesce("_label", "period_label").alias("period_label"), F.coalesce("is_active", F.lit(True)).alias("is_active"),
        F.when(F.col("new").isNotNull(), again).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("_seen", "last_seen_date").alias("last_seen_date"), n.cast("int").alias("occurrences"),
    )


def arrival_scans(tx: DataFrame, statements: DataFrame, arrived: DataFrame, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """The postings that the detection of each arrived statement reads, named by at and at_end.

    Those are its card's postings since lookback days before its end: all on statements that had arrived before, newer
    ones too, and those on the arrived statements up to it in order of (period_end, id).  A posting meets statements
    by card and month of their end, and is copied only for months in which a statement of its card has arrived.
    """
    ends = arrived.where(F.col("period_end").isNotNull())
    own = statements.where(F.col("period_end").isNotNull()).select(F.col("id").alias("statement_id"), "period_end")
    own = own.join(ends.select(F.col("id").alias("statement_id"), F.lit(True).alias("_now")), "statement_id", "left")
    to = ends.select(F.col("credit_card_id").alias("card_id"), F.col("id").alias("at"), F.col("period_end").alias("at_end"), F.trunc("period_end", "MM").alias("_month"))
    months = to.groupBy("card_id").agg(F.collect_set("_month").alias("_months"))
    rows = tx.drop("period_end").where(F.col("installment_number").isNull() & F.col("merchant_id").isNotNull()).join(own, "statement_id").join(months, "card_id")
    last = F.date_add("date", lookback)
    near = F.filter("_months", lambda m: (m <= last) & (F.col("_now").isNull() | (m >= F.trunc("period_end", "MM"))))
    met = rows.withColumn("_month", F.explode(near)).drop("_months").join(to, ["card_id", "_month"])
    met = met.where((F.col("at_end") <= last) & (F.col("_now").isNull() | (F.struct("at_end", "at") >= F.struct("period_end", "statement_id"))))
    return met.drop("_month", "period_end", "_now")


def replay(tx: DataFrame, statements: DataFrame, rules: DataFrame, arrived: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rules and linked postings after detection at each arrived statement in turn, by (period_end, id); all statements by default.

    A late statement is another that arrives: it sees newer postings, and as the last detected gives its rules' last day.

    A rule met for the first time counts the postings in band; later ones add the postings of the statement that are
    not yet linked to it, so a second run over linked postings adds nothing.  The last statement gives day and
    confidence.  A statement's postings within a detection's bounds are linked to its rule, instalments too.

    What the detections find is written once, to the shared folder: rules and links read it several times.
    """
    scan = arrival_scans(tx, statements, statements if arrived is None else arrived)
    return after_detections(staged(arrival_stats(scan)), tx, rules)


def arrival_stats(scan: DataFrame) -> DataFrame:
    """What detection finds in the postings that each arrived statement sees."""
    return recurring_group_stats(scan, ("at", "at_end", "merchant_id", "currency"))


def after_detections(found: DataFrame, tx: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules, and tx with links, after what was found at arrived statements in order of (at_end, at); of tx only those statements' postings matter."""
    found = found.join(rules.select(F.col("id").alias("_old"), *KEY), list(KEY), "left").withColumn("_rule", F.coalesce("_old", surrogate_key(*KEY)))
    linked = tx if "recurring_rule_id" in tx.columns else tx.withColumn("recurring_rule_id", F.lit(None).cast("string"))
    bounds = found.select(F.col("at").alias("statement_id"), "merchant_id", "currency", F.col("amount_min").alias("_low"), F.col("amount_max").alias("_high"), "at_end", "_rule")
    # a statement has one detection for each merchant and currency
    both = linked.join(bounds, ["statement_id", "merchant_id", "currency"], "left")
    hit = F.coalesce(F.col("amount").between(F.col("_low"), F.col("_high")), F.lit(False))
    open_ = hit & F.col("installment_number").isNull() & (F.col("date") >= F.date_sub("at_end", LOOKBACK_DAYS)) & ~F.col("recurring_rule_id").eqNullSafe(F.col("_rule"))
    fresh = both.where(open_).groupBy(F.col("statement_id").alias("at"), "merchant_id", "currency").agg(F.count("*").alias("_fresh"))
    counted = found.join(fresh, ["at", "merchant_id", "currency"], "left").withColumn("_fresh", F.coalesce("_fresh", F.lit(0)))
    met = counted.groupBy(*KEY).agg(
        F.sum("_fresh").alias("_sum"), F.min(F.struct("at_end", "at", (F.col("n") - F.col("_fresh")).alias("more"))).alias("_first"), F.max(F.struct("at_end", "at", "last_seen_date", "median")).alias("_last"), F.max("_old").alias("_old"),
    )
    new = F.col("_sum") + F.when(F.col("_old").isNull(), F.col("_first.more")).otherwise(0)
    met = met.select(*KEY, classify_period(F.col("period_days")).alias("_label"), F.col("_last.last_seen_date").alias("_seen"), new.alias("new"), F.col("_last.median").alias("median"))
    after = both.withColumn("recurring_rule_id", F.when(hit, F.col("_rule")).otherwise(F.col("recurring_rule_id"))).select(*linked.columns)
    return _merged(rules, met), after


def backfill_rule_id(tx: DataFrame, rules: DataFrame, detected: DataFrame, statements: DataFrame) -> DataFrame:
    """tx with recurring_rule_id: postings of the newest statements that lie within their detection's bounds get its rule; others keep theirs.

    A card has one detection for a merchant and currency, so a posting meets one rule at most.
    """
    hits = _of_detections(tx, statements, detected).select("id", "merchant_id", "currency", *(F.col(f"_{c}").alias(c) for c in ("amount_min", "amount_max", "period_days")))
    hits = hits.join(rules.select(F.col("id").alias("_rule"), *KEY), list(KEY)).select("id", "_rule")
    old = F.col("recurring_rule_id") if "recurring_rule_id" in tx.columns else F.lit(None).cast("string")
    return tx.join(hits, "id", "left").withColumn("recurring_rule_id", F.coalesce("_rule", old)).drop("_rule")


def _magnitude(amount):
    """A number for amounts of about one size; amounts of nothing and refunds have one of their own."""
    return F.when(amount > 0, F.floor(F.log(amount.cast("double")) / math.log(1 + float(BAND)))).otherwise(NONE).cast("int")


def recurring_in_period(tx: DataFrame, rules: DataFrame, period: date) -> DataFrame:
    """Active rules of merchants and currencies with a posting in the month near some rule's amounts.

    Postings are ordered with the rules' lower bounds within merchant, currency and magnitude, each value once: one is near some
    rule if the highest upper bound that starts up to it reaches it.  So no pair of posting and rule is made.
    """
    start, end = month_bounds(period)
    r = active(rules)
    low, high = F.col("amount_min") * F.lit(0.85).cast("decimal(3,2)"), F.col("amount_max") * F.lit(1.15).cast("decimal(3,2)")
    rows = by_month(tx, start, end).select("merchant_id", "currency", "amount").distinct().withColumn("_size", _magnitude(F.col("amount")))
    near = r.select("merchant_id", "currency", low.alias("low"), high.alias("high")).distinct()
    none = F.expr("cast(array() as array<int>)")
    # one more at either end than rounding can need
    sizes = F.when(F.col("high") > 0, F.sequence(_magnitude(F.greatest("low", F.lit(0.01))) - 1, _magnitude(F.col("high")) + 1)).otherwise(none)
    near = near.where("low <= high").withColumn("_size", F.explode(F.concat(sizes, F.when(F.col("low") <= 0, F.array(F.lit(NONE))).otherwise(none))))
    group = ["merchant_id", "currency", "_size"]
    starts = near.groupBy(*group, "low").agg(F.max("high").alias("high")).withColumn("_posting", F.lit(False))
    points = rows.select(*group, F.col("amount").alias("low"), F.lit(None).alias("high"), F.lit(True).alias("_posting"))
    # of equal values the bound comes first
    reach = F.max("high").over(Window.partitionBy(*group).orderBy("low", "_posting").rowsBetween(Window.unboundedPreceding, 0))
    pairs = starts.unionByName(points).withColumn("_reach", reach).where("_posting and low <= _reach").select("merchant_id", "currency").distinct()
    return list_rules(r.join(pairs, ["merchant_id", "currency"], "left_semi"))


def recurring_kpi(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count("*").alias("n_rules"), F.coalesce(F.sum(F.when(F.col("currency") == "CLP", F.col("amount_min").cast("bigint"))), F.lit(0)).alias("clp_total"))


def toggle_rules(rules: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: id, is_active."""
    e = edits.select("id", F.col("is_active").alias("_new"))
    return rules.join(e, "id", "left").withColumn("is_active", F.coalesce("_new", "is_active")).drop("_new")


def detection_report(detected: DataFrame, statement: str = "statement_id", failed_chunks: str = "failed_chunks") -> DataFrame:
    return detected.groupBy(statement).agg(F.count("*").alias("n_rules"), (F.max(failed_chunks) > 0).alias("partial"))
