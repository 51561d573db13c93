"""A query for each ledger operator on the given tables, and the same in SQL."""

import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.period import Selection
from .operators import extraction as X
from .operators import filters as L
from .operators import maintenance as M
from .operators import merchants as C
from .operators import recurring as R
from .operators import rollups as A
from .operators import windows as W
from .plans import dashboard as P
from .plans import ingest as I
from .sources import model
from .sources.ledger import event_statements, ledger_events, ledger_lineitem
from .sources.snapshots import Change, Snapshots
from .sources.staging import shared_folder

MONTH, AS_OF = date(1998, 1, 1), date(1998, 3, 15)

LINE = """tx as (
select l_orderkey as statement_id, o_custkey as card_id, c_nationkey as bank_id, cast(l_shipdate as date) as date, p_brand || ' ' || s_name as description,
  cast(case when l_returnflag = 'R' then -cast(l_extendedprice as decimal(15,2)) else cast(l_extendedprice as decimal(15,2)) end as decimal(15,2)) as amount,
  case when l_linestatus = 'O' then 'CLP' else 'USD' end as currency, case when l_quantity >= 3 then l_partkey % 12 + 1 end as category_id,
  l_discount >= 0.09 as low_confidence, l_suppkey as merchant_id, s_name as merchant_name, case when l_tax >= 0.07 then l_linenumber end as installment_number
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey)"""
EVENT = """ev as (
select event_id as id, user_id as card_id, user_id * 100 + month(ts) as statement_id, cast(ts as date) as date, event_type as description, cast(value as decimal(15,2)) as amount,
  case when event_id % 4 = 0 then 'USD' else 'CLP' end as currency, event_type as merchant_id, event_type as merchant_name, props as raw_json
from events where cast(value as decimal(15,2)) > 0)"""
CATS = "cats as (select * from (values " + ", ".join(f"({k}, '{n}', {k})" for k, (n, _) in enumerate(model.CATEGORIES, 1)) + ") as c(id, name, sort_order))"
SUM = "cast(sum(amount) as decimal(25,2))"
IN_MONTH = "date between date '1998-01-01' and date '1998-01-31'"

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def line(spark, d):
    return ledger_lineitem(spark, d)


def events(spark, d):
    return ledger_events(spark, d)


def categories(spark) -> DataFrame:
    return model.seed_categories(spark).withColumn("id", F.col("id").cast("long"))


def suppliers(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


# -- sources -----------------------------------------------------------------


@query(f"with {LINE}, {CATS} select statement_id, date, amount, currency, category_id, name as category_name, merchant_id, description, low_confidence, installment_number from tx left join cats on category_id = id")
def source_wide_lineitem(spark, d):
    tx = line(spark, d).drop("merchant_name").withColumn("recurring_rule_id", F.lit(None).cast("string"))
    statements = tx.groupBy(F.col("statement_id").alias("id"), F.col("card_id").alias("credit_card_id")).agg(F.min("date").alias("period_start"), F.max("date").alias("period_end"))
    wide = model.wide_transactions(tx, statements, categories(spark).withColumn("display_name", F.col("name")), suppliers(spark, d), _no_rules(spark))
    return wide.select("statement_id", "date", "amount", "currency", "category_id", "category_name", "merchant_id", "description", "low_confidence", "installment_number")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


@query(f"with {EVENT} select id, date, amount, currency from ev where date between date '2024-01-10' and date '2024-02-20'")
def source_committed_months(spark, d):
    """Postings committed by month, of which a window reads two."""
    at = Snapshots(spark, _folder(spark))
    tx = events(spark, d).select(*(F.col(c).cast("string").alias(c) if c in ("id", "statement_id", "merchant_id") else F.col(c) for c in ("id", "statement_id", "date", "description", "amount", "currency", "merchant_id", "installment_number", "raw_json")))
    missing = {f.split()[0]: f.split()[1] for f in "category string, category_id string, low_confidence boolean, installment_total int, installment_value decimal, recurring_rule_id string".split(", ")}
    at.commit(0, {"transactions": Change(tx.select("*", *(F.lit(None).cast(t).alias(n) for n, t in missing.items())))})
    return L.window_filter(at.read("transactions"), date(2024, 1, 10), date(2024, 2, 20)).select(F.col("id").cast("long").alias("id"), "date", "amount", "currency")


@query(f"with {EVENT} select id, statement_id, amount from ev where statement_id = 701")
def source_load(spark, d):
    """A table read by its known schema, and one statement of it."""
    at = _folder(spark)
    events(spark, d).select("id", "statement_id", "date", "amount").write.parquet(at)
    return L.filter_transactions(model.load(spark, at, "id long, statement_id long, date date, amount decimal(15,2)"), statement=701).select("id", "statement_id", "amount")


@query("""select 'd' || (event_id % 50) as doc_id, cast(count(*) filter (where event_id % 7 <> 0) as bigint) as n_whole, cast(count(*) filter (where event_id % 7 = 0) as bigint) as n_failed, 0::bigint as n_rejected from events where event_id % 11 <> 0 group by 1
union all select null, 0, 0, count(*) from events where event_id % 11 = 0""")
def source_corrupt_payloads(spark, d):
    """Replies written line by line, some cut short: one that still names its document is a failed chunk, one that does not is rejected."""
    e, at = spark.read.parquet(f"{d}/events.parquet"), _folder(spark)
    doc = F.concat(F.lit("d"), F.col("event_id") % 50)
    body = F.concat(F.lit('{"doc_id":"'), doc, F.lit('","chunk_idx":'), F.col("event_id"), F.lit(',"body":"{}"}'))
    short = F.when(F.col("event_id") % 11 == 0, F.substring("line", 1, 9)).when(F.col("event_id") % 7 == 0, F.expr("substring(line, 1, length(line) - 2)")).otherwise(F.col("line"))
    e.withColumn("line", body).select(short.alias("value")).write.text(at)
    good, rejected = model.split_corrupt(model.read_payloads(spark, at))
    whole = good.groupBy("doc_id").agg(F.count("body").alias("n_whole"), F.count_if(F.col("body").isNull()).alias("n_failed"), F.lit(0).cast("long").alias("n_rejected"))
    return whole.unionByName(rejected.groupBy("doc_id").agg(F.lit(0).cast("long").alias("n_whole"), F.lit(0).cast("long").alias("n_failed"), F.count("*").alias("n_rejected")))


@query(f"with {EVENT}, k as (select statement_id, count(*) as n_transactions, min(id) as first_id, max(id) as last_id, {SUM} as total from ev group by 1) select statement_id, n_transactions, first_id, last_id, total from k")
def source_statement_detail(spark, d):
    tx = events(spark, d)
    nested = model.statement_detail(event_statements(tx), tx)
    ids = F.transform("transactions", lambda t: t["id"])
    money = F.aggregate("transactions", F.lit(0).cast("decimal(25,2)"), lambda a, t: (a + t["amount"]).cast("decimal(25,2)"))
    return nested.select(F.col("id").alias("statement_id"), F.col("n_transactions").cast("long").alias("n_transactions"), F.array_min(ids).alias("first_id"), F.array_max(ids).alias("last_id"), money.alias("total"))


@query("select event_id, event_type, user_id from events")
def source_raw_payload(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    raw = e.select(model.raw_payload("event_id", "event_type", "user_id").alias("raw"))
    return raw.select(F.from_json("raw", "event_id long, event_type string, user_id long").alias("r")).select("r.*")


@query("select s_nationkey as bank_id, count(*) as n_files, count(*) filter (where s_acctbal < 0) as n_failed from supplier group by 1")
def source_split_failed(spark, d):
    """A row with a negative balance fails its statement."""
    s = spark.read.parquet(f"{d}/supplier.parquet").withColumn("statement_id", F.col("s_suppkey")).withColumn("row_error", F.when(F.col("s_acctbal") < 0, F.lit("negative")))
    good, failed = model.split_failed(s)
    both = good.select("statement_id", F.lit(0).alias("bad")).unionByName(failed.select("statement_id", F.lit(1).alias("bad")))
    return both.join(s.select("statement_id", "s_nationkey"), "statement_id").groupBy(F.col("s_nationkey").alias("bank_id")).agg(F.count("*").alias("n_files"), F.sum("bad").cast("long").alias("n_failed"))


@query(f"with {EVENT} select md5(cast(id as varchar)) as key, row_number() over (partition by strftime(date, '%Y-%m'), currency order by date, id) - 1 as slot, make_date(year(date), month(date), least((row_number() over (partition by strftime(date, '%Y-%m'), currency order by date, id) - 1) * 3 + 2, day(last_day(date)))) as slot_date from ev")
def source_fixture_slots(spark, d):
    tx = events(spark, d).withColumn("at", F.struct("date", "id"))
    return W.with_slot(tx, "at").select(F.md5(F.col("id").cast("string")).alias("key"), F.col("slot").cast("long").alias("slot"), "slot_date")


# -- filters -----------------------------------------------------------------


@query(f"with {LINE} select statement_id, date, description, amount, currency, category_id, low_confidence from tx where date between date '1996-01-01' and date '1997-06-30' and abs(amount) between 1000 and 30000 and lower(description) like '%brand#1%' and currency = 'USD' and (category_id in (1, 2, 3) or category_id is null or low_confidence)")
def filter_criteria(spark, d):
    tx = L.filter_transactions(line(spark, d), date_from=date(1996, 1, 1), date_to=date(1997, 6, 30), amount_min=1000, amount_max=30000, contains="brand#1", currency="USD", categories=[1, 2, 3], uncategorized=True)
    return tx.select("statement_id", "date", "description", "amount", "currency", "category_id", "low_confidence")


@query(f"with {LINE} select statement_id, date, amount from tx where category_id is null or low_confidence")
def filter_uncategorized(spark, d):
    return L.filter_transactions(line(spark, d), uncategorized=True).select("statement_id", "date", "amount")


@query(f"with {LINE} select statement_id, date, amount, currency from tx where {IN_MONTH}")
def filter_month(spark, d):
    return L.month_filter(line(spark, d), MONTH).select("statement_id", "date", "amount", "currency")


@query(f"with {EVENT} select id, date, amount from ev where card_id = 7")
def filter_card(spark, d):
    tx = events(spark, d)
    return L.card_filter(tx, event_statements(tx), 7).select("id", "date", "amount")


@query(f"with {EVENT} select id, date, amount, currency from ev order by date, id limit 50 offset 100")
def filter_page(spark, d):
    return L.page(events(spark, d), 50, 100).select("id", "date", "amount", "currency")


@query("select c_custkey as id, n_name || ' - ' || c_name as label from customer join nation on c_nationkey = n_nationkey where c_acctbal >= 0 order by c_nationkey, c_name")
def filter_card_labels(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("bank_id"), F.col("c_name").alias("card_number_masked"), (F.col("c_acctbal") >= 0).alias("is_active"))
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("display_name"))
    return L.card_labels(L.list_cards(c), n).select("id", "label")


@query("""select 'bank' as list, name from (select n_name as name from nation where n_regionkey <> 2 order by 1 limit 6) union all select 'merchant', name from (select s_name as name from supplier order by 1 limit 7)
union all select 'category', name from (select * from (values ('Dining Out'), ('Groceries'), ('Transportation')) as c(name))""")
def filter_lists(spark, d):
    """The first of the banks, merchants and categories as they are listed."""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("display_name"), (F.col("n_regionkey") != 2).alias("is_active"))
    lists = {"bank": L.list_banks(n).limit(6).select("display_name"), "merchant": L.list_merchants(suppliers(spark, d)).limit(7).select("name"), "category": L.list_categories(categories(spark)).limit(3).select("name")}
    each = [df.toDF("name").select(F.lit(k).alias("list"), "name") for k, df in lists.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"with {EVENT}, s as (select card_id, max(date) as period_end from ev group by 1) select id, card_id, date, amount from ev join s using (card_id) where date >= period_end - 90 and merchant_id is not null")
def filter_detector_scan(spark, d):
    tx = events(spark, d)
    return R.detector_scan(tx, event_statements(tx)).select("id", "card_id", "date", "amount")


# -- rollups -----------------------------------------------------------------


@query(f"with {LINE} select currency, {SUM} as total, count(*) as txn_count from tx where {IN_MONTH} group by 1")
def rollup_totals_by_currency(spark, d):
    return A.totals_by_currency(L.month_filter(line(spark, d), MONTH))


@query(f"with {LINE} select min(date) as earliest from tx")
def rollup_earliest_date(spark, d):
    return A.earliest_date(line(spark, d))


@query(f"with {LINE} select count(*) as n from tx where category_id is null or low_confidence")
def rollup_transaction_count(spark, d):
    return A.transaction_count(L.filter_transactions(line(spark, d), uncategorized=True))


@query(f"with {LINE} select distinct strftime(date, '%Y-%m') as month from tx")
def rollup_distinct_months(spark, d):
    return A.distinct_months(line(spark, d))


@query(f"with {LINE} select category_id, currency, {SUM} as total, count(*) as txn_count from tx where category_id is not null group by 1, 2")
def rollup_category_currency(spark, d):
    return A.category_currency_rollup(line(spark, d))


@query(f"with {LINE}, {CATS}, r as (select category_id, currency, {SUM} as total from tx where {IN_MONTH} and category_id is not null group by 1, 2), b as (select category_id from r join cats on category_id = id group by category_id, sort_order order by max(total) desc, sort_order limit 1) select category_id, currency, total from r where category_id in (select category_id from b)")
def rollup_top_category(spark, d):
    return A.top_category(L.month_filter(line(spark, d), MONTH), categories(spark))


@query(f"with {LINE}, r as (select merchant_id, merchant_name, currency, {SUM} as total from tx where {IN_MONTH} group by 1, 2, 3), b as (select merchant_id from r group by merchant_id, merchant_name order by max(total) desc, merchant_name, merchant_id limit 1) select merchant_id, merchant_name, currency, total from r where merchant_id in (select merchant_id from b)")
def rollup_top_merchant(spark, d):
    return A.top_merchant(L.month_filter(line(spark, d), MONTH).drop("merchant_name"), suppliers(spark, d))


@query(f"""with {LINE}, {CATS}, m as (select * from tx where {IN_MONTH}), r as (select category_id, currency, {SUM} as total, count(*) as txn_count from m where category_id is not null group by 1, 2),
w as (select currency, {SUM} as period_total from m group by 1), x as (select *, row_number() over (partition by category_id order by abs(total) desc, currency) as k, max(total) over (partition by category_id) as max_total from r),
p as (select category_id, x.currency as dominant_currency, max_total, case when period_total > 0 then cast(total as double) / cast(period_total as double) else 0.0 end as raw from x join w on x.currency = w.currency where k = 1)
select cats.id as category_id, name, sort_order, r.currency, total, coalesce(txn_count, 0) as txn_count, dominant_currency, round(case when p.category_id is null then 0.0 else raw end, 4) as pct, round(case when p.category_id is null then 0.0 else raw end, 4) between 0 and 1 as pct_valid, max_total
from cats left join r on r.category_id = cats.id left join p on p.category_id = cats.id""")
def rollup_category_breakdown(spark, d):
    return A.category_breakdown(L.month_filter(line(spark, d), MONTH), categories(spark))


@query(f"""with {LINE}, r as (select merchant_id, merchant_name, currency, {SUM} as total, count(*) as n, max(date) as seen from tx where {IN_MONTH} group by 1, 2, 3),
t as (select merchant_id, merchant_name, max(total) as max_total, cast(sum(n) as bigint) as count_all, max(seen) as last_seen from r group by 1, 2 order by max_total desc, merchant_name, merchant_id limit 10)
select t.merchant_id, currency, total, max_total, count_all, last_seen, t.merchant_name from t join r using (merchant_id)""")
def rollup_merchant_breakdown(spark, d):
    return A.merchant_breakdown(L.month_filter(line(spark, d), MONTH).drop("merchant_name"), suppliers(spark, d))


# -- series ------------------------------------------------------------------

SERIES = f"m as (select strftime(date, '%Y-%m') as month, currency, {SUM} as total from tx group by 1, 2)"


@query(f"""with {LINE}, {SERIES}, months as (select distinct month from m), cur as (select distinct currency from m), g as (select month, cur.currency, total, lag(total) over (partition by cur.currency order by month) as before from months cross join cur left join m using (month, currency))
select month, currency, total, case when before <> 0 then round(cast((total - before) / before * 100 as double), 1) end as prev_pct from g where total is not null""")
def series_monthly_prev_pct(spark, d):
    return A.monthly(line(spark, d), 0, AS_OF)


@query(f"""with {LINE}, {SERIES}, months as (select strftime(unnest(generate_series(date '1997-04-01', date '1998-03-01', interval 1 month)), '%Y-%m') as month), own as (select * from m where month in (select month from months)), cur as (select distinct currency from own),
g as (select month, cur.currency, total, lag(total) over (partition by cur.currency order by month) as before from months cross join cur left join own using (month, currency))
select months.month, g.currency, total, case when before <> 0 then round(cast((total - before) / before * 100 as double), 1) end as prev_pct from months left join (select * from g where total is not null) g on g.month = months.month""")
def series_monthly_rolling(spark, d):
    return A.monthly(line(spark, d), 12, AS_OF)


@query(f"""with {LINE}, m as (select strftime(date, '%Y-%m') as month, currency, {SUM} as total from tx where date between date '2001-09-01' and date '2002-02-28' group by 1, 2), months as (select strftime(unnest(generate_series(date '2001-09-01', date '2002-02-01', interval 1 month)), '%Y-%m') as month), cur as (select distinct currency from m),
g as (select month, cur.currency, total, lag(total) over (partition by cur.currency order by month) as before from months cross join cur left join m using (month, currency))
select months.month, g.currency, total, case when before <> 0 then round(cast((total - before) / before * 100 as double), 1) end as prev_pct from months left join (select * from g where total is not null) g on g.month = months.month""")
def series_monthly_window(spark, d):
    return A.monthly_window(line(spark, d), date(2001, 9, 10), date(2002, 2, 5))


@query(f"with {LINE}, {SERIES} select month, currency, total, case when max(total) over (partition by currency) > 0 then round_even(cast(total as double) / cast(max(total) over (partition by currency) as double) * 100, 1) else 0.0 end as bar_width from m")
def series_bar_width(spark, d):
    return W.with_bar_width(A.monthly_totals(line(spark, d)))


def _summary_sql(first, last, start, end, prior, prior_end, days):
    part = "cast(sum(case when date between date '{}' and date '{}' then amount end) as decimal(25,2))"
    now, before, whole = part.format(first, last), part.format(prior, prior_end), part.format(start, end)
    n = f"count(case when date between date '{start}' and date '{end}' then 1 end)"
    return f"""with {LINE}, s as (select currency, {whole} as total, {n} as txn_count, {now} as month_total, {before} as prior_total from tx group by 1)
select date '{first}' as period_start, date '{end}' as period_end, currency, total, txn_count, cast(round_even(cast(total as double) / {days}, 2) as decimal(25,2)) as daily_avg, month_total, prior_total, case when prior_total <> 0 then round(cast(month_total - prior_total as double) / cast(prior_total as double) * 100, 1) end as change_pct from s where txn_count > 0"""


@query(_summary_sql("1998-01-01", "1998-01-31", "1998-01-01", "1998-01-31", "1997-12-01", "1997-12-31", 31))
def series_summary(spark, d):
    return P.summary(line(spark, d), Selection(MONTH))


@query(_summary_sql("1998-06-01", "1998-06-30", "1998-01-01", "1998-06-30", "1998-05-01", "1998-05-31", 30))
def series_summary_ytd(spark, d):
    return P.summary(line(spark, d), Selection(date(1998, 6, 1), mode="ytd"))


OVERVIEW = f"""with {LINE}, {CATS}, s as (select * from tx where card_id = 7), w as (select * from s where date between date '1997-01-01' and date '1998-12-31'),
cur as (select currency, cast(sum(case when date between date '1997-01-01' and date '1998-12-31' then amount end) as decimal(25,2)) as total, count(case when date between date '1997-01-01' and date '1998-12-31' then 1 end) as txn_count,
  cast(sum(case when date between date '1998-12-01' and date '1998-12-31' then amount end) as decimal(25,2)) as month_total, cast(sum(case when date between date '1998-11-01' and date '1998-11-30' then amount end) as decimal(25,2)) as prior_total from s group by 1),
c as (select category_id as e, currency, {SUM} as total, count(*) as n from w where category_id is not null group by 1, 2), bc as (select e, name from c join cats on id = e group by e, name, sort_order order by max(total) desc, sort_order limit 1),
m as (select merchant_id as e, merchant_name as name, currency, {SUM} as total, count(*) as n from w group by 1, 2, 3), bm as (select e from m group by e, name order by max(total) desc, name limit 1)
select 'currency' as kind, null as entity, null as name, currency, total, txn_count, cast(round_even(cast(total as double) / 31, 2) as decimal(25,2)) as daily_avg, month_total, prior_total,
  case when prior_total <> 0 then round(cast(month_total - prior_total as double) / cast(prior_total as double) * 100, 1) end as change_pct from cur where txn_count > 0
union all select 'category', cast(e as varchar), name, currency, total, n, null, null, null, null from c join bc using (e)
union all select 'merchant', cast(e as varchar), name, currency, total, n, null, null, null, null from m where e in (select e from bm)"""


@query(OVERVIEW.replace("1997-01-01", "1998-01-01"))
def series_overview(spark, d):
    """A card's year to date: totals, top category and top merchant from one scan."""
    selection = Selection(date(1998, 12, 1), card=7, mode="ytd")
    # orders are the statements; of the lines only the card's are joined to all they refer to
    statements = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("credit_card_id"))
    own = line(spark, d).drop("merchant_name").where(F.col("card_id") == selection.card)
    return P.overview(own, selection, categories(spark), suppliers(spark, d), statements=statements)


@query(OVERVIEW.replace("where card_id = 7", "").replace("date between date '1997-01-01' and date '1998-12-31'", "date <= date '1998-12-31'"))
def series_overview_all_time(spark, d):
    """All cards since the first posting."""
    return P.overview(line(spark, d).drop("merchant_name"), Selection(date(1998, 12, 1), mode="all_time"), categories(spark), suppliers(spark, d))


# -- recurring ---------------------------------------------------------------

STATS = f"""{EVENT}, s as (select card_id, max(date) as period_end from ev group by 1), f as (select ev.* from ev join s using (card_id) where date >= period_end - 90),
md as (select *, cast(median(cast(amount as double)) over (partition by card_id, merchant_id, currency) as decimal(18,3)) as median from f), b as (select * from md where amount between median * cast(0.85 as decimal(3,2)) and median * cast(1.15 as decimal(3,2))),
g as (select *, date_diff('day', lag(date) over (partition by card_id, merchant_id, currency order by date, id), date) as gap from b),
st as (select card_id, merchant_id, currency, count(*) as n, max(median) as median, min(amount) as amount_min, max(amount) as amount_max, max(date) as last_seen_date, cast(round_even(median(gap), 0) as integer) as period_days from g group by 1, 2, 3),
r as (select * from st where n >= 3 and period_days > 0)"""
LABEL = "case when period_days <= 10 then 'weekly' when period_days <= 18 then 'biweekly' when period_days <= 45 then 'monthly' when period_days <= 120 then 'quarterly' else 'yearly' end"
CONFIDENCE = "round(least(1.0, n / 5.0) * greatest(0.0, 1 - cast(amount_max - amount_min as double) / cast(median as double)), 4)"


@query(f"with {EVENT} select id, cast(median(cast(amount as double)) over (partition by card_id, merchant_id, currency) as decimal(18,3)) as median from ev")
def recurring_group_median(spark, d):
    return W.with_group_median(events(spark, d)).select("id", "median")


@query(f"with {STATS} select card_id, merchant_id, currency, n, median, amount_min, amount_max, last_seen_date, period_days from r")
def recurring_group_stats(spark, d):
    tx = events(spark, d)
    return R.recurring_group_stats(R.detector_scan(tx, event_statements(tx)))


@query(f"with {STATS} select card_id, merchant_id, currency, n, median, amount_min, amount_max, last_seen_date, period_days, {LABEL} as period_label, {CONFIDENCE} as confidence from r")
def recurring_detect(spark, d):
    tx = events(spark, d)
    return R.detect(tx, event_statements(tx))


def _no_rules(spark):
    return spark.createDataFrame([], model.RULES)


def _rules(spark, d):
    tx = events(spark, d)
    st = event_statements(tx)
    return R.upsert_rules(_no_rules(spark), R.detect(tx, st), tx, st)


RULE = f"{STATS}, u as (select merchant_id, amount_min, amount_max, currency, period_days, cast(sum(n) as integer) as occurrences, max(last_seen_date) as last_seen_date, arg_max(median, (last_seen_date, card_id)) as median from r group by 1, 2, 3, 4, 5)"


@query(f"with {RULE} select merchant_id, amount_min, amount_max, currency, period_days, {LABEL} as period_label, true as is_active, {CONFIDENCE.replace('n / 5.0', 'occurrences / 5.0')} as confidence, last_seen_date, occurrences from u")
def recurring_upsert_rules(spark, d):
    return _rules(spark, d).drop("id")


NEWEST = f"{RULE}, nw as (select card_id, arg_max(statement_id, (stop, statement_id)) as statement_id, max(stop) as last_day from (select card_id, statement_id, max(date) as stop from ev group by 1, 2) group by 1)"
IN_BAND = "from ev join nw using (card_id, statement_id) join r using (card_id, merchant_id, currency) where amount between amount_min and amount_max"


@query(f"with {NEWEST}, v as (select merchant_id, amount_min, amount_max, currency, period_days, count(*) as fresh {IN_BAND} and id % 3 <> 1 and date >= last_day - 90 group by 1, 2, 3, 4, 5) select merchant_id, amount_min, amount_max, currency, period_days, cast(occurrences + coalesce(fresh, 0) as integer) as occurrences from u left join v using (merchant_id, amount_min, amount_max, currency, period_days)")
def recurring_upsert_again(spark, d):
    """A second run where a third of the postings are linked to their rule and a third to another one: rules met again add all but the first."""
    tx = events(spark, d)
    st, rules = event_statements(tx), _rules(spark, d)
    own = R.backfill_rule_id(tx.where("id % 3 = 1"), rules, R.detect(tx, st), st)
    other = tx.where("id % 3 <> 1").withColumn("recurring_rule_id", F.when(F.col("id") % 3 == 0, "r"))
    linked = own.unionByName(other)
    return R.upsert_rules(rules, R.detect(tx, st), linked, st).select("merchant_id", "amount_min", "amount_max", "currency", "period_days", "occurrences")


def _linked(spark, d):
    tx = events(spark, d)
    st = event_statements(tx)
    return R.backfill_rule_id(tx, _rules(spark, d), R.detect(tx, st), st)


@query(f"with {NEWEST}, j as (select ev.id {IN_BAND}) select ev.id, j.id is not null as linked from ev left join j on j.id = ev.id")
def recurring_backfill(spark, d):
    return _linked(spark, d).select("id", F.col("recurring_rule_id").isNotNull().alias("linked"))


@query(f"with {NEWEST}, j as (select ev.id, {LABEL} as period_label {IN_BAND}), sp as (select statement_id, min(date) as period_start, max(date) as period_end from ev group by 1) select ev.id, period_start, period_end, case when merchant_id <> 'view' then merchant_name end as merchant_name, period_label from ev join sp using (statement_id) left join j on j.id = ev.id")
def source_wide_events(spark, d):
    """Every posting with what it refers to; one merchant is not in the table."""
    tx = _linked(spark, d).withColumn("category_id", F.lit("1"))
    merchants = tx.where("merchant_id <> 'view'").select(F.col("merchant_id").alias("id"), F.col("merchant_name").alias("name")).distinct()
    wide = model.wide_transactions(tx.drop("merchant_name"), event_statements(tx), model.seed_categories(spark), merchants, _rules(spark, d))
    return wide.select("id", "period_start", "period_end", "merchant_name", "period_label")


@query(f"with {RULE}, p as (select distinct merchant_id, currency from ev join u using (merchant_id, currency) where date between date '2024-01-01' and date '2024-01-31' and amount between amount_min * cast(0.85 as decimal(3,2)) and amount_max * cast(1.15 as decimal(3,2))) select merchant_id, currency, amount_min, amount_max, period_days, last_seen_date from u join p using (merchant_id, currency)")
def recurring_in_period(spark, d):
    return R.recurring_in_period(events(spark, d), _rules(spark, d), date(2024, 1, 1)).select("merchant_id", "currency", "amount_min", "amount_max", "period_days", "last_seen_date")


@query(f"with {RULE} select count(*) as n_rules, cast(coalesce(sum(case when currency = 'CLP' then cast(floor(amount_min) as bigint) end), 0) as bigint) as clp_total from u")
def recurring_kpi(spark, d):
    return R.recurring_kpi(_rules(spark, d))


@query(f"with {RULE} select merchant_id, amount_min, amount_max, currency, period_days, currency <> 'USD' as is_active from u")
def recurring_toggle(spark, d):
    rules = _rules(spark, d)
    edits = rules.where("currency = 'USD'").select("id", F.lit(False).alias("is_active"))
    return R.toggle_rules(rules, edits).select("merchant_id", "amount_min", "amount_max", "currency", "period_days", "is_active")


@query(f"with {RULE}, k as (select *, row_number() over (partition by merchant_id, currency, amount_min, amount_max, period_days) as z from u) select merchant_id, amount_min, amount_max, currency, period_days, occurrences from k where z = 1")
def recurring_surviving(spark, d):
    rules = _rules(spark, d)
    return W.surviving_rules(rules.unionByName(rules.withColumn("confidence", F.lit(-1.0)))).select("merchant_id", "amount_min", "amount_max", "currency", "period_days", "occurrences")


REPLAY = f"""{EVENT}, t as (select * replace (card_id * 1000 + date_diff('day', date '2024-01-01', date) // 7 as statement_id) from ev), s as (select statement_id, card_id, max(date) as period_end from t group by 1, 2),
f as (select s.statement_id as stop, s.period_end as at_end, t.* from t join s o on o.statement_id = t.statement_id join s on s.card_id = t.card_id where (s.period_end > o.period_end or (s.period_end = o.period_end and s.statement_id >= o.statement_id)) and t.date >= s.period_end - 90),
md as (select *, cast(median(cast(amount as double)) over (partition by stop, merchant_id, currency) as decimal(18,3)) as median from f), b as (select * from md where amount between median * cast(0.85 as decimal(3,2)) and median * cast(1.15 as decimal(3,2))),
g as (select *, date_diff('day', lag(date) over (partition by stop, merchant_id, currency order by date, id), date) as gap from b),
st as (select stop, at_end, merchant_id, currency, count(*) as n, count(*) filter (where statement_id = stop) as fresh, max(median) as median, min(amount) as amount_min, max(amount) as amount_max, max(date) as last_seen_date, cast(round_even(median(gap), 0) as integer) as period_days from g group by 1, 2, 3, 4),
r as (select * from st where n >= 3 and period_days > 0),
u as (select merchant_id, amount_min, amount_max, currency, period_days, cast(sum(fresh) + arg_min(n - fresh, (at_end, stop)) as integer) as occurrences, arg_max(last_seen_date, (at_end, stop)) as last_seen_date, arg_max(median, (at_end, stop)) as median from r group by 1, 2, 3, 4, 5)"""


def _weekly(spark, d):
    tx = events(spark, d)
    return tx.withColumn("statement_id", F.col("card_id") * 1000 + F.floor(F.datediff("date", F.lit(date(2024, 1, 1))) / 7))


@query(f"with {REPLAY} select merchant_id, amount_min, amount_max, currency, period_days, {LABEL} as period_label, true as is_active, {CONFIDENCE.replace('n / 5.0', 'occurrences / 5.0')} as confidence, last_seen_date, occurrences from u")
def recurring_replay_rules(spark, d):
    tx = _weekly(spark, d)
    return R.replay(tx, event_statements(tx), _no_rules(spark))[0].drop("id")


@query(f"with {REPLAY} select t.id, r.stop is not null as linked, r.amount_min, r.amount_max, r.period_days from t left join r on r.stop = t.statement_id and r.merchant_id = t.merchant_id and r.currency = t.currency and t.amount between r.amount_min and r.amount_max")
def recurring_replay_links(spark, d):
    tx = _weekly(spark, d)
    rules, linked = R.replay(tx, event_statements(tx), _no_rules(spark))
    named = linked.select(F.col("id"), F.col("recurring_rule_id").alias("rule")).join(rules.select(F.col("id").alias("rule"), "amount_min", "amount_max", "period_days"), "rule", "left")
    return named.select("id", F.col("rule").isNotNull().alias("linked"), "amount_min", "amount_max", "period_days")


@query(f"with {STATS} select card_id as statement_id, count(*) as n_rules, card_id % 3 = 0 as partial from r group by 1")
def recurring_report(spark, d):
    tx = events(spark, d)
    found = R.detect(tx, event_statements(tx)).withColumn("statement_id", F.col("card_id")).withColumn("failed_chunks", F.when(F.col("card_id") % 3 == 0, 1).otherwise(0))
    return R.detection_report(found)


# -- text --------------------------------------------------------------------

NORMAL = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?i)\b(SpA|LTDA|CIA|SUCURSAL|SUC|COM)\b', ' ', 'g'), '(\d+/\d+)|[;.,/]|\d', '\1' || chr(1), 'g'), '(\d+/\d+)' || chr(1), '\1', 'g'), chr(1) || '+', ' ', 'g')), '\s+', ' ', 'g'))"""


@query("select distinct d as description, " + NORMAL.format("d") + " as canonical from (select p_brand || ' SUC ' || p_size || ' com ' || p_size || '/24 ' || p_name || ' LTDA' as d from part)")
def text_normalize_merchant(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.concat("p_brand", F.lit(" SUC "), "p_size", F.lit(" com "), "p_size", F.lit("/24 "), "p_name", F.lit(" LTDA")).alias("description"))
    return C.with_canonical(p.distinct()).select("description", "canonical")


@query("select distinct d as description, " + NORMAL.format("plain") + " as canonical from (select p_brand || ' SUC ' || p_size || '/24 ' || p_name as plain, p_brand || ' SUC ' || p_size || '/24 ' || translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'ⓐⓑⓒⓓⓔⓕⓖⓗⅰⓙⓚⓛⓜⓝⓞⓟⓠⓡⓢⓣⓤⅴⓦⅹⓨⓩ') as d from part)")
def text_normalize_exact(spark, d):
    """Names in circled letters and Roman numerals."""
    name = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", "ⓐⓑⓒⓓⓔⓕⓖⓗⅰⓙⓚⓛⓜⓝⓞⓟⓠⓡⓢⓣⓤⅴⓦⅹⓨⓩ")
    p = spark.read.parquet(f"{d}/part.parquet").select(F.concat("p_brand", F.lit(" SUC "), "p_size", F.lit("/24 "), name).alias("description"))
    return C.with_canonical(p.distinct()).select("description", "canonical")


@query("select doc_id, sha256(strip_accents(text)) as folded from documents")
def text_fold_accents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(F.encode(T.fold_accents(F.col("text")), "UTF-8"), 256).alias("folded"))


@query("select l_orderkey, l_linenumber, cast(l_extendedprice as decimal(15,2)) as usd, cast(floor(l_extendedprice) as decimal(15,2)) as clp from lineitem")
def text_parse_amount(spark, d):
    """Prices written in local notation and read again."""
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(15,2)").alias("a"))
    us = F.translate(F.format_number(F.col("a"), 2), ",.", ".,")
    pesos = F.concat(F.lit("$ "), F.translate(F.format_number(F.floor("a"), 0), ",", "."))
    return x.select("l_orderkey", "l_linenumber", T.parse_amount(F.concat(F.lit("US$ "), us), F.lit("usd")).alias("usd"), T.parse_amount(pesos, F.lit("CLP")).alias("clp"))


@query("select o_orderkey, cast(o_orderdate as date) as a, cast(o_orderdate as date) as b, cast(o_orderdate as date) as c, 'ok' as status from orders")
def text_parse_date(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("d", F.to_date("o_orderdate"))
    forms = [F.date_format("d", f) for f in ("dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd")]
    return o.select("o_orderkey", *(T.parse_date(f).alias(n) for f, n in zip(forms, "abc", strict=True)), T.date_status(forms[0]).alias("status"))


@query("""with t as (select doc_id, 'ESTADO DE CUENTA ' || case when doc_id % 3 = 0 then 'INTERNACIONAL' when doc_id % 3 = 1 then 'NACIONAL' else 'EN PESOS' end || chr(10) || text as text from documents)
select doc_id, case when doc_id % 3 = 0 then 'INTERNACIONAL' when doc_id % 3 = 1 then 'NACIONAL' end as variant from t""")
def text_detect_variant(spark, d):
    return _statements(spark, d).select("doc_id", T.detect_variant(F.col("text")).alias("variant"))


def _statements(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    head = F.when(F.col("doc_id") % 3 == 0, "INTERNACIONAL").when(F.col("doc_id") % 3 == 1, "NACIONAL").otherwise("EN PESOS")
    return model.read_statement_texts(docs.select("doc_id", F.concat(F.lit("ESTADO DE CUENTA "), head, F.lit("\n"), "text").alias("text")), "doc_id", "text")


@query("""with t as (select doc_id, text || 'DETALLE' || text as t from documents), p as (select doc_id, t, strpos(t, 'DETALLE') as pos from t)
select doc_id, case when length(t) <= 2000 then t else substr(t, case when pos > 101 then pos else 1 end, 2000) end as cut from p""")
def text_truncate(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat("text", F.lit("DETALLE"), "text").alias("t"))
    return docs.select("doc_id", T.truncate_text(F.col("t"), F.lit("none"), 2000).alias("cut"))


def _chunks_sql(texts: str, size: int, overlap: int) -> str:
    half = size // 2
    tail = f"strpos(reverse(substr(text, s + {half}, {size - half + 1})), chr(10))"
    stop = f"case when s + {size} < length(text) and {tail} > 0 then s + {size + 1} - {tail} else least(length(text), s + {size}) end as stop"
    return f"""with recursive t as ({texts}),
cut as (select doc_id, text, k, s, {stop} from (select doc_id, text, 0 as k, cast(0 as bigint) as s from t where text is not null)
union all select doc_id, text, k, s, {stop} from (select doc_id, text, k + 1 as k, greatest(stop - {overlap}, s + 1) as s from cut where stop < length(text)))
select doc_id, cast(k as integer) as chunk_idx, substr(text, s + 1, stop - s) as chunk from cut"""


@query(_chunks_sql("select doc_id, text from documents", 5000, 200))
def text_chunks(spark, d):
    return T.chunk_text(spark.read.parquet(f"{d}/documents.parquet"))


@query(_chunks_sql("""select doc_id, case when doc_id % 3 = 1 and pos > 101 then substr(text, 1, pos - 1) when doc_id % 3 = 1 and word > 101 then substr(text, 1, word - 1) when doc_id % 3 = 2 and pos > 101 then substr(text, 1, 500) || substr(text, pos) when doc_id % 3 = 2 and word > 101 then substr(text, 1, 500) || substr(text, word) else text end as text
from (select doc_id, text, strpos(text, 'ESTADO DE CUENTA INTERNACIONAL') as pos, strpos(text, 'INTERNACIONAL') as word from (select doc_id, 'ESTADO DE CUENTA ' || case when doc_id % 3 = 0 then 'INTERNACIONAL' when doc_id % 3 = 1 then 'NACIONAL' else 'EN PESOS' end || chr(10) || replace(text, ' the ', chr(10)) || chr(10) || 'ESTADO DE CUENTA INTERNACIONAL' || chr(10) || text as text from documents))""", 400, 40))
def text_chunks_of_variant(spark, d):
    """Statements with both sections, of which the detected variant's stays."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    body = F.concat(F.replace("text", F.lit(" the "), F.lit("\n")), F.lit("\nESTADO DE CUENTA INTERNACIONAL\n"), "text")
    texts = _statements(spark, d).select("doc_id", F.substring_index("text", "\n", 1).alias("head")).join(docs.select("doc_id", body.alias("body")), "doc_id")
    both = texts.select("doc_id", F.concat_ws("\n", "head", "body").alias("text"))
    return T.chunk_text(both, size=400, overlap=40, variant=T.detect_variant(F.col("text")))


@query("select conv_id, turn, coalesce(nullif(trim(text), ''), role) as name, case when length('RowError: ' || replace(replace(text, chr(10), ' '), chr(13), ' ')) > 500 then substr('RowError: ' || replace(replace(text, chr(10), ' '), chr(13), ' '), 1, 499) || '…' else 'RowError: ' || replace(replace(text, chr(10), ' '), chr(13), ' ') end as error from conversations")
def text_error_and_name(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", T.canonical_name(F.col("text"), F.col("role"), F.lit("raw")).alias("name"), T.error_text(F.lit("RowError"), F.col("text")).alias("error"))


@query("select conv_id, turn, sha256(conv_id || chr(31) || turn || chr(31) || role) as key, regexp_replace(text, '^[ \\t\\r\\n\\f\\v]+|[ \\t\\r\\n\\f\\v]+$', '', 'g') as inside from conversations")
def text_keys_and_fences(spark, d):
    """Every text in a fence, whose inside is the text without outer blanks."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n```"))
    return c.select("conv_id", "turn", T.surrogate_key("conv_id", "turn", "role").alias("key"), F.regexp_replace(T.strip_fence(fenced), r"^\s+|\s+$", "").alias("inside"))


@query("select p_partkey, p_size, case when p_size <= 10 then 'weekly' when p_size <= 18 then 'biweekly' when p_size <= 45 then 'monthly' else 'quarterly' end as label from part")
def text_classify_period(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", T.classify_period(F.col("p_size")).alias("label"))


# -- merchants and categories ------------------------------------------------


@query(f"with {LINE}, {CATS}, x as (select statement_id, date, amount, case when category_id is null then null when category_id = 5 then 'Fun' else upper(name) end as label, category_id from tx left join cats on id = category_id) select statement_id, date, amount, case when category_id <> 5 then category_id end as category_id, coalesce((select name from cats where id = category_id and category_id <> 5), label, 'Uncategorized') as category_label from x")
def category_resolve(spark, d):
    c = categories(spark)
    names = c.select(F.col("id").alias("category_id"), F.upper("name").alias("n"))
    tx = line(spark, d).join(F.broadcast(names), "category_id", "left").withColumn("category", F.when(F.col("category_id") == 5, "Fun").otherwise(F.col("n")))
    return C.resolve_categories(tx, c).select("statement_id", "date", "amount", "category_id", "category_label")


@query("select o_orderkey, case o_orderkey % 4 when 0 then 'Bills' when 1 then 'Groceries' when 2 then 'Dining Out' else 'Uncategorized' end as canonical_category from orders")
def category_alias(spark, d):
    label = F.element_at(F.array(F.lit(" Utilities"), F.lit("GROCERY"), F.lit("Dïning Out "), F.lit("no such")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", label.alias("label"))
    return C.category_alias(o, "label").select("o_orderkey", "canonical_category")


def _aliases(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    text = F.concat(F.lit("brand# "), F.lower("s_name"))
    return s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_suppkey").cast("string").alias("merchant_id"), F.col("s_name").alias("alias_text"), T.normalize_merchant(text).alias("normalized"), F.lit("auto").alias("source"), F.lit(1.0).alias("confidence"))


ALIAS = "al as (select " + NORMAL.format("'brand# ' || lower(s_name)") + " as normalized, max(cast(s_suppkey as varchar)) as merchant_id from supplier where s_suppkey % 2 = 0 group by 1)"


@query(f"with {LINE}, {ALIAS}, k as (select statement_id, date, amount, {NORMAL.format('description')} as canonical from tx) select statement_id, date, amount, canonical, merchant_id from k left join al on normalized = canonical")
def merchant_alias_hit(spark, d):
    tx = C.with_canonical(line(spark, d).drop("merchant_id"))
    return C.match_aliases(tx, _aliases(spark, d)).select("statement_id", "date", "amount", "canonical", "merchant_id")


@query("with k as (select " + NORMAL.format("p_name || ' SUC 3'") + " as canonical, min(p_name || ' SUC 3') as alias_text from part group by 1), z as (select " + NORMAL.format("p_name") + " as normalized from part where p_name < 'n') select canonical as name, alias_text, 'auto' as source from k where canonical not in (select normalized from z)")
def merchant_resolve_new(spark, d):
    """The merchants that descriptions make, with the alias of each, where those of the first letters are known."""
    p = spark.read.parquet(f"{d}/part.parquet")
    key = F.col("p_partkey").cast("string")
    known = p.where("p_name < 'n'").select(key.alias("id"), key.alias("merchant_id"), F.col("p_name").alias("alias_text"), T.normalize_merchant(F.col("p_name")).alias("normalized"), F.lit("auto").alias("source"), F.lit(1.0).alias("confidence"))
    merchants = spark.createDataFrame([], "id string, name string, default_category_id long, is_active boolean")
    _, aliases, after = C.resolve_merchants(p.select(key.alias("id"), F.concat("p_name", F.lit(" SUC 3")).alias("description")), known, merchants, categories(spark))
    return after.join(aliases.select(F.col("merchant_id").alias("id"), "alias_text", "source"), "id").select("name", "alias_text", "source")


@query("select s_suppkey as key, case when s_suppkey % 3 = 0 then 'blank' when s_acctbal < 0 then 'unknown merchant' end as reason, case when s_suppkey % 3 <> 0 and s_acctbal >= 0 then " + NORMAL.format("s_name || '-' || s_suppkey") + " end as normalized from supplier")
def merchant_add_aliases(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    merchants = s.where("s_acctbal >= 0").select(F.col("s_suppkey").cast("string").alias("id"))
    new = s.select(F.col("s_suppkey").cast("string").alias("merchant_id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" "), F.lpad(F.lit(""), F.col("s_suppkey").cast("int"), F.lit(" ")))).otherwise(F.concat("s_name", F.lit("-"), "s_suppkey")).alias("alias_text"))
    empty = spark.createDataFrame([], "id string, merchant_id string, alias_text string, normalized string, source string, confidence double")
    after, rejected = C.add_aliases(empty, merchants, new)
    good = after.select(F.col("merchant_id").cast("long").alias("key"), F.lit(None).cast("string").alias("reason"), "normalized")
    return good.unionByName(rejected.select(F.col("merchant_id").cast("long").alias("key"), "reason", F.lit(None).cast("string").alias("normalized")))


@query("with m as (select " + NORMAL.format("p_name") + " as name, min(p_partkey) as id from part where p_name < 'n' group by 1) select p_partkey as raw, m.id is null as is_new, cast(m.id as varchar) as known from part left join m on m.name = " + NORMAL.format("p_name || ' SpA'"))
def merchant_bind_suggestions(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    merchants = p.where("p_name < 'n'").select(F.col("p_partkey").alias("id"), T.normalize_merchant(F.col("p_name")).alias("name"))
    merchants = merchants.groupBy("name").agg(F.min("id").cast("string").alias("id"))
    bound = C.bind_suggestions(p.select(F.col("p_partkey").alias("raw"), F.concat("p_name", F.lit(" SpA")).alias("suggestion")), merchants)
    return bound.select("raw", "is_new", F.when(~F.col("is_new"), F.col("merchant_id")).alias("known"))


# -- extraction --------------------------------------------------------------


def _replies(spark, d):
    """Orders as documents, each line of one a chunk's reply; every seventh chunk fails."""
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice", F.to_date("l_shipdate").alias("day")).distinct()
    row = F.struct(F.date_format("day", "dd/MM/yyyy").alias("date"), F.lit(" Shop ").alias("description"), F.translate(F.format_number(F.col("l_extendedprice").cast("decimal(15,2)"), 2), ",.", ".,").alias("amount"), F.lit("USD").alias("currency"))
    meta = F.struct(F.col("l_orderkey").cast("string").alias("card_number_masked"), F.lit("x").alias("cardholder"), F.lit("USD").alias("currency"))
    one = x.withColumn("k", F.struct("l_extendedprice", "day")).groupBy("l_orderkey", "l_linenumber").agg(F.sort_array(F.collect_list(F.struct("k", row.alias("row"), meta.alias("meta")))).alias("all"))
    body = F.to_json(F.struct(F.transform("all", lambda a: a["row"]).alias("transactions"), F.col("all")[0]["meta"].alias("metadata"), F.lit(0.9).alias("confidence"), F.lit("note").alias("notes")))
    bad = F.col("l_orderkey") % 7 == 0
    return one.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").cast("int").alias("chunk_idx"), F.when(~bad, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("body"))


@query("select cast(l_orderkey as varchar) as doc_id, case when l_orderkey % 7 <> 0 then count(distinct l_linenumber) else 0 end as n_ok, case when l_orderkey % 7 = 0 then count(distinct l_linenumber) else 0 end as n_failed, case when l_orderkey % 7 <> 0 then cast(0.9 as double) end as confidence, case when l_orderkey % 7 <> 0 then cast(l_orderkey as varchar) end as card from lineitem group by l_orderkey")
def extraction_merge_chunks(spark, d):
    wrapped = _replies(spark, d).withColumn("body", F.to_json(F.struct(F.struct(F.col("body").alias("content")).alias("message"))))
    return X.merge_chunks(X.parse_replies(wrapped)).select("doc_id", "n_ok", "n_failed", "confidence", F.col("metadata.card_number_masked").alias("card"))


@query("""select cast(l_orderkey as varchar) as doc_id, l_linenumber as chunk_idx, case l_orderkey % 5 when 0 then 'extra mood' when 1 then 'extra metadata.bank' when 2 then 'extra transactions.tip, extra transactions.vat' when 3 then 'extra mood, extra transactions.tip, extra metadata.bank' end as broken
from lineitem group by 1, 2, l_orderkey, l_linenumber""")
def extraction_extra_keys(spark, d):
    """Replies with keys of their own on each level, which make a chunk fail."""
    k = F.col("l_orderkey") % 5
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    tip, bank, mood = (F.when(c, F.lit(t)).otherwise("") for c, t in ((k == 3, ',"tip":1'), (k.isin(1, 3), ',"bank":"b"'), (k.isin(0, 3), ',"mood":{"a":[1]}')))
    rows = F.when(k == 2, F.lit('{"date":"01/02/2026","description":"d","amount":"1","currency":"USD","tip":2},{"date":"01/02/2026","description":"d","amount":"1","currency":"USD","vat":null,"tip":3}')).otherwise(F.concat(F.lit('{"date":"01/02/2026","description":"d","amount":"1","currency":"USD"'), tip, F.lit("}")))
    body = F.concat(F.lit('{"transactions":['), rows, F.lit('],"metadata":{"currency":"USD"'), bank, F.lit('},"confidence":0.5'), mood, F.lit("}"))
    checked = X.check_replies(X.parse_replies(x.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").cast("long").alias("chunk_idx"), body.alias("body"))))
    return checked.select("doc_id", "chunk_idx", F.when(F.col("reply").isNull(), F.regexp_replace("error", "^ValidationError: ", "")).alias("broken"))


@query("select cast(l_orderkey as varchar) as doc_id, cast(l_shipdate as date) as date, cast(l_extendedprice as decimal(15,2)) as amount from lineitem where l_orderkey % 7 <> 0 group by 1, 2, 3")
def extraction_rows(spark, d):
    wrapped = _replies(spark, d).withColumn("body", F.to_json(F.struct(F.struct(F.col("body").alias("content")).alias("message"))))
    rows = W.dedupe_extracted(X.extracted_rows(X.parse_replies(wrapped)))
    return X.typed_rows(rows, "USD").where("row_error is null").select("doc_id", F.col("parsed_date").alias("date"), F.col("parsed_amount").alias("amount"))


@query("select o_custkey as credit_card_id, o_orderstatus || o_orderpriority as file_hash from orders where o_orderstatus <> 'F' and (o_custkey, o_orderstatus || o_orderpriority) not in (select o_custkey, o_orderstatus || o_orderpriority from orders where o_orderkey % 5 = 0) group by 1, 2")
def extraction_new_statements(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("credit_card_id"), F.concat("o_orderstatus", "o_orderpriority").alias("file_hash"))
    return X.new_statements(o.where("o_orderstatus <> 'F'"), o.where("o_orderkey % 5 = 0")).select("credit_card_id", "file_hash")


@query("select c_nationkey as bank_id, c_mktsegment as card_number_masked, 'holder' as cardholder from customer group by 1, 2")
def extraction_cards(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("bank_id"), F.col("c_mktsegment").alias("card_number_masked"), F.lit("holder").alias("cardholder"), F.lit("CLP").alias("currency"), F.col("c_name").alias("file_hash"))
    none = spark.createDataFrame([], "id string, bank_id int, card_number_masked string, cardholder string, currency string, is_active boolean")
    first = X.get_or_create_cards(none, c.where("bank_id < 10"))
    return X.get_or_create_cards(first, c).select("bank_id", "card_number_masked", "cardholder")


# -- ingest ------------------------------------------------------------------


def _few(spark, schema, *rows):
    """A table of these rows, which Spark knows to be small, as it does not of one made from Python's objects."""
    names = [f.split()[0] for f in schema.split(", ")]
    made = F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(made))


def _ingested(spark, d):
    """Orders as statement files and their lines as chunks; some files, chunks and rows are bad, one shop has an alias and one is a known merchant.

    Lines are dealt by document before they are written out as replies, so chunks and files come to the plan as it deals them.
    """
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    x = lines.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").cast("decimal(15,2)").alias("p"), F.to_date("l_shipdate").alias("day"))
    k, n = F.col("k"), F.col("n")
    shop = F.when(k % 4 == 0, "LIDER COM 3").when(k % 4 == 1, "Kiosko").when(k % 4 == 2, "Bazar SpA").otherwise("77")

    def row(line):
        return F.struct(
            F.date_format(line["day"], "dd/MM/yyyy").alias("date"), shop.alias("description"), F.concat(F.lit("US$ "), F.translate(F.format_number(line["p"], 2), ",.", ".,")).alias("amount"),
            F.when((k % 13 == 0) & (n == 2), "CLP").otherwise("USD").alias("currency"), F.when(k % 5 == 0, "GROCERIES ").when(k % 5 == 1, "Fun").alias("category"),
        )

    meta = F.struct(F.when(k % 2 == 0, k.cast("string")).otherwise("").alias("card_number_masked"), F.lit("x").alias("cardholder"), F.when(k % 11 == 0, "CLP").when(k % 11 == 1, "CLP or USD").otherwise("USD").alias("currency"), F.lit("").alias("period_start"), F.lit("2001-12-31").alias("period_end"))
    chunks = x.repartition("doc_id").groupBy("doc_id", "k", "n").agg(F.collect_list(F.struct("day", "p")).alias("lines"))
    body = F.to_json(F.struct(F.sort_array(F.transform("lines", row)).alias("transactions"), meta.alias("metadata"), F.when((n == 3) & (k % 3 == 0), 2.0).otherwise(0.9).alias("confidence")))
    payloads = chunks.select("doc_id", n.cast("int").alias("chunk_idx"), F.when(k % 7 != 0, body).alias("body"))
    files = x.select("doc_id").distinct().select("doc_id", (F.col("doc_id").cast("long") % 3).alias("bank_id"), F.concat("doc_id", F.lit(".pdf")).alias("file_path"), F.md5("doc_id").alias("file_hash"), F.lit("INTERNACIONAL").alias("variant"))
    cards = _few(spark, "id string, bank_id long, card_number_masked string, cardholder string, currency string, is_active boolean")
    aliases = _few(spark, "id string, merchant_id string, alias_text string, normalized string, source string, confidence double", ("1", "m1", "Kiosko", "kiosko", "user", 1.0))
    merchants = _few(spark, "id string, name string, default_category_id string, is_active boolean", ("m1", "kiosko", None, True))
    return I.ingest(payloads, files, _few(spark, model.STATEMENTS), cards, aliases, merchants, model.seed_categories(spark), date(2002, 1, 15))


INGEST = """with x as (select distinct l_orderkey as k, l_linenumber as n, cast(l_extendedprice as decimal(15,2)) as p, cast(l_shipdate as date) as day from lineitem), o as (select distinct k from x),
c as (select * from x where k % 7 <> 0 and not (n = 3 and k % 3 = 0)), e as (select k, day, p, min(n) as n from c group by 1, 2, 3), st as (select k, bool_or(k % 13 = 0 and n = 2) as failed from e where k % 11 <> 0 group by 1)"""


@query(f"{INGEST} select cast(k as varchar) as doc_id, case when k not in (select k from c) then 'ExtractionError: all chunks failed' else 'IngestionError: metadata currency is not the variant''s' end as error from o where k not in (select k from st)")
def ingest_rejected(spark, d):
    return _ingested(spark, d).rejected


@query(f"{INGEST} select md5(cast(k as varchar)) as file_hash, case when k % 2 = 0 then cast(k as varchar) else 'UNKNOWN-' || substr(md5(cast(k as varchar)), 1, 8) end as card_number_masked, k % 3 as bank_id, date '2002-01-15' as period_start, date '2001-12-31' as period_end, case when failed then 'failed' else 'completed' end as status, case when failed then 'CurrencyError: CLP' end as error_message from st")
def ingest_statements(spark, d):
    out = _ingested(spark, d)
    cards = out.cards.select(F.col("id").alias("credit_card_id"), "card_number_masked", "bank_id")
    return out.statements.join(cards, "credit_card_id").select("file_hash", "card_number_masked", "bank_id", "period_start", "period_end", "status", "error_message")


@query(f"""{INGEST} select md5(cast(k as varchar)) as file_hash, day as date, p as amount, 'USD' as currency, case k % 5 when 0 then 'Groceries' when 1 then 'Fun' else 'Uncategorized' end as category, case k % 4 when 0 then 'lider' when 1 then 'kiosko' when 2 then 'bazar' end as merchant,
k % 5 <> 0 or k % 4 = 2 as low_confidence from e join st using (k) where not failed""")
def ingest_postings(spark, d):
    out = _ingested(spark, d)
    files, names = out.statements.select(F.col("id").alias("statement_id"), "file_hash"), out.merchants.select(F.col("id").alias("merchant_id"), F.col("name").alias("merchant"))
    return out.transactions.join(files, "statement_id").join(names, "merchant_id", "left").select("file_hash", "date", "amount", "currency", "category", "merchant", "low_confidence")


# -- maintenance -------------------------------------------------------------


def _editable(spark, d):
    return events(spark, d).withColumn("category_id", (F.col("id") % 12 + 1).cast("long")).withColumn("category", F.lit("old")).withColumn("low_confidence", F.col("id") % 2 == 0)


@query(f"with {EVENT}, {CATS} select ev.id, case when ev.id % 10 = 0 then (case when ev.id % 13 = 12 then ev.id % 12 + 1 else ev.id % 13 + 1 end) when ev.id % 10 in (1, 2) then null else ev.id % 12 + 1 end as category_id, case when ev.id % 10 = 0 then (case when ev.id % 13 = 12 then 'old' else (select name from cats where cats.id = ev.id % 13 + 1) end) when ev.id % 10 = 1 then null when ev.id % 10 = 2 then 'mine' else 'old' end as category, case when ev.id % 10 = 0 then (case when ev.id % 13 = 12 then ev.id % 2 = 0 else false end) when ev.id % 10 in (1, 2) then true else ev.id % 2 = 0 end as low_confidence from ev")
def maintenance_category_edits(spark, d):
    tx = _editable(spark, d)
    m = F.col("id") % 10
    action = F.when(m == 0, "set").when(m == 1, "clear").when(m == 2, "text")
    edits = tx.where(m < 3).select("id", action.alias("action"), F.when(m == 0, F.col("id") % 13 + 1).alias("category_id"), F.when(m == 2, "mine").alias("label"))
    return M.apply_category_edits(tx, edits, categories(spark))[0].select("id", "category_id", "category", "low_confidence")


@query(f"with {EVENT} select id, case when id % 12 + 1 = 3 then 'Moves' else 'old' end as category from ev")
def maintenance_rename_categories(spark, d):
    renames = spark.createDataFrame([(3, "Moves"), (4, "GROCERIES")], "id long, name string")
    return M.rename_categories(categories(spark), _editable(spark, d), renames)[1].select("id", "category")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def maintenance_cascade_delete(spark, d):
    o, c = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    return M.cascade_delete(o, c.where("c_acctbal < 0").select(F.col("c_custkey").alias("id")), "o_custkey").select("o_orderkey")


@query("select o_orderkey, case when o_custkey not in (select c_custkey from customer where c_acctbal < 0) then o_custkey end as o_custkey from orders")
def maintenance_set_null(spark, d):
    o, c = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    return M.set_null(o, c.where("c_acctbal < 0").select(F.col("c_custkey").alias("id")), "o_custkey").select("o_orderkey", "o_custkey")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def maintenance_check_unique(spark, d):
    return M.check_unique(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal >= 0)")
def maintenance_check_fk(spark, d):
    x, s = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/supplier.parquet")
    return M.check_fk(x, s.where("s_acctbal >= 0"), "l_suppkey", "s_suppkey").select("l_orderkey", "l_linenumber")


@query(f"with {EVENT} select id, case when id % 3 = 0 then amount + 1 else amount end as amount, case when id % 3 = 0 then 'demo' else 'user' end as origin from ev")
def maintenance_guarded_upsert(spark, d):
    tx = events(spark, d).select("id", "amount")
    target = tx.withColumn("origin", F.when(F.col("id") % 3 == 0, "demo").otherwise("user"))
    batch = tx.where("id % 3 = 0").withColumn("amount", (F.col("amount") + 1).cast("decimal(15,2)"))
    once, _ = M.guarded_upsert(target, batch, "id", "origin", "demo")
    return M.guarded_upsert(once, batch, "id", "origin", "demo")[0]
