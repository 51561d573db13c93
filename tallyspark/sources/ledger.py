"""Two ledgers projected from order and event tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as card postings: returns are refunds, suppliers are merchants."""
    line, orders, customer = (_read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    supplier, part = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "part")
    amount = F.col("l_extendedprice").cast("decimal(15,2)")
    # orders meet their customers first, so that lines are dealt once for both
    headers = orders.join(customer, orders.o_custkey == customer.c_custkey)
    tx = line.join(headers, line.l_orderkey == headers.o_orderkey)
    tx = tx.join(supplier, line.l_suppkey == supplier.s_suppkey).join(part, line.l_partkey == part.p_partkey)
    return tx.select(
        F.col("l_orderkey").alias("statement_id"), F.col("o_custkey").alias("card_id"), F.col("c_nationkey").alias("bank_id"), F.to_date("l_shipdate").alias("date"),
        F.concat_ws(" ", "p_brand", "s_name").alias("description"), F.when(F.col("l_returnflag") == "R", -amount).otherwise(amount).cast("decimal(15,2)").alias("amount"),
        F.when(F.col("l_linestatus") == "O", "CLP").otherwise("USD").alias("currency"), F.when(F.col("l_quantity") >= 3, F.col("l_partkey") % 12 + 1).alias("category_id"),
        (F.col("l_discount") >= 0.09).alias("low_confidence"), F.col("l_suppkey").alias("merchant_id"), F.col("s_name").alias("merchant_name"), F.when(F.col("l_tax") >= 0.07, F.col("l_linenumber")).alias("installment_number"),
    )


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a positive value as postings; event types are merchants and users are cards."""
    e = _read(spark, sf_dir, "events")
    amount = F.col("value").cast("decimal(15,2)")
    return e.where(amount > 0).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("card_id"), (F.col("user_id") * 100 + F.month("ts")).alias("statement_id"), F.to_date("ts").alias("date"), F.col("event_type").alias("description"),
        amount.alias("amount"), F.when(F.col("event_id") % 4 == 0, "USD").otherwise("CLP").alias("currency"), F.col("event_type").alias("merchant_id"), F.col("event_type").alias("merchant_name"),
        F.lit(None).cast("int").alias("installment_number"), F.col("props").alias("raw_json"),
    )


def event_statements(tx: DataFrame) -> DataFrame:
    """id, credit_card_id, period_start, period_end of the statements that postings name."""
    return tx.groupBy(F.col("statement_id").alias("id"), F.col("card_id").alias("credit_card_id")).agg(F.min("date").alias("period_start"), F.max("date").alias("period_end"))
