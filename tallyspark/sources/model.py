"""Schemas of the ledger's tables, and its fixed dimensions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import error_text

TRANSACTIONS = (
    "id string, statement_id string, date date, description string, amount decimal(15,2), currency string, category string, category_id string, "
    "low_confidence boolean, merchant_id string, installment_number int, installment_total int, installment_value decimal(15,2), recurring_rule_id string, raw_json string"
)
STATEMENTS = (
    "id string, credit_card_id string, period_start date, period_end date, statement_date date, file_path string, file_hash string, status string, error_message string"
)
RULES = (
    "id string, merchant_id string, period_days int, period_label string, amount_min decimal(15,2), amount_max decimal(15,2), currency string, is_active boolean, confidence double, last_seen_date date, occurrences int"
)
ROWS = "array<struct<date:string, description:string, amount:string, currency:string, category:string, installment_number:int, installment_total:int, installment_value:string>>"
METADATA = "struct<card_number_masked:string, cardholder:string, currency:string, period_start:string, period_end:string, statement_date:string>"
EXTRACTION = f"struct<transactions: {ROWS}, metadata: {METADATA}, confidence:double, notes:string>"

# The closed set of categories in their order, and the banks.
CATEGORIES = (
    ("Dining Out", "Dining Out"), ("Groceries", "Groceries"), ("Transportation", "Transportation"), ("Shopping", "Shopping"), ("Entertainment", "Entertainment"), ("Bills", "Bills & Utilities"),
    ("Health", "Health & Medical"), ("Travel", "Travel"), ("Subscriptions", "Subscriptions"), ("Personal Care", "Personal Care"), ("Uncategorized", "Uncategorized"), ("Other", "Other"),
)
BANKS = (("santander", "Banco Santander"), ("itau", "Itaú"), ("banco_de_chile", "Banco de Chile"))
# Canonical merchants with a known category.
KNOWN_MERCHANTS = (
    ("mcdonalds", "Dining Out"), ("starbucks", "Dining Out"), ("lider", "Groceries"), ("paris", "Shopping"), ("sodimac", "Shopping"), ("easy", "Shopping"), ("amazon", "Shopping"),
    ("copec", "Transportation"), ("shell", "Transportation"), ("uber", "Transportation"), ("netflix", "Subscriptions"), ("spotify", "Subscriptions"),
)
# Other names of categories.
CATEGORY_ALIASES = (
    ("dining", "Dining Out"), ("dining out", "Dining Out"), ("groceries", "Groceries"), ("grocery", "Groceries"), ("transport", "Transportation"), ("transportation", "Transportation"), ("services", "Bills"), ("bills", "Bills"), ("utilities", "Bills"),
    ("subscriptions", "Subscriptions"), ("shopping", "Shopping"), ("health", "Health"), ("travel", "Travel"), ("entertainment", "Entertainment"), ("personal care", "Personal Care"), ("other", "Other"), ("uncategorized", "Uncategorized"),
)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table of a known schema: no inference, and only the columns asked for are read."""
    return spark.read.schema(schema).parquet(path)


def seed_categories(spark: SparkSession, names=CATEGORIES) -> DataFrame:
    return spark.createDataFrame([(str(k), n, d, k) for k, (n, d) in enumerate(names, 1)], "id string, name string, display_name string, sort_order int")


def seed_banks(spark: SparkSession, banks=BANKS) -> DataFrame:
    return spark.createDataFrame([(str(k), n, d, True) for k, (n, d) in enumerate(banks, 1)], "id string, name string, display_name string, is_active boolean")


def wide_transactions(tx: DataFrame, statements: DataFrame, categories: DataFrame, merchants: DataFrame, rules: DataFrame) -> DataFrame:
    """Transactions with the columns of what they refer to; missing references are null."""
    s = statements.select(F.col("id").alias("statement_id"), "credit_card_id", "period_start", "period_end")
    c = categories.select(F.col("id").alias("category_id"), F.col("display_name").alias("category_name"))
    m = merchants.select(F.col("id").alias("merchant_id"), F.col("name").alias("merchant_name"))
    r = rules.select(F.col("id").alias("recurring_rule_id"), "period_label")
    return tx.join(s, "statement_id", "left").join(c, "category_id", "left").join(m, "merchant_id", "left").join(r, "recurring_rule_id", "left")


def scan_statement_files(spark: SparkSession, path: str, max_mb: int = 10) -> DataFrame:
    """path, length, file_hash (SHA-256, null for files that are too large) and rejected_reason (null if accepted) of uploaded files.

    One scan lists the files and opens none; the other, whose bound on the length is pushed down to the listing, opens only those that may be accepted.  Spark lists no empty files.
    """
    top = max_mb * 1048576
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    opened = spark.read.format("binaryFile").load(path).where(F.col("length") <= top)
    magic = F.substring("content", 1, 5) == F.unhex(F.lit("255044462D"))
    read = opened.select("path", F.sha2("content", 256).alias("file_hash"), magic.alias("_magic"))
    reason = F.when(F.col("length") > top, "too large").when(~F.coalesce("_magic", F.lit(False)), "not a PDF")
    return listed.join(read, "path", "left").select("path", "length", "file_hash", reason.alias("rejected_reason"))


PAYLOADS = "doc_id string, chunk_idx int, body string"


def read_payloads(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """doc_id, chunk_idx, body, path, corrupt: one model reply for each chunk of a document; corrupt is a line that could not be read, or null."""
    reader = spark.read.schema(f"{PAYLOADS}, corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
    if format != "json":
        return spark.read.schema(PAYLOADS).format(format).load(path).select("*", F.col("_metadata.file_path").alias("path"), F.lit(None).cast("string").alias("corrupt"))
    return reader.json(path).select("doc_id", "chunk_idx", "body", F.col("_metadata.file_path").alias("path"), "corrupt")


def split_corrupt(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payloads that can be used, and rejected (doc_id, path, error) lines.

    A broken line that still names its document is a chunk that failed, so the document is judged by its other chunks; its
    chunk_idx is the line's, or below all others.  One that names none, or a whole line without a document, is rejected.
    """
    said = lambda pattern: F.nullif(F.regexp_extract("corrupt", pattern, 1), F.lit(""))
    doc = F.coalesce("doc_id", said(r'"doc_id"\s*:\s*"((?:[^"\\]|\\.)+)"'))
    chunk = F.coalesce("chunk_idx", said(r'"chunk_idx"\s*:\s*(-?\d{1,9})\b').cast("int"), F.lit(-1))
    body = F.when(F.col("corrupt").isNull(), F.col("body"))
    read = payloads.select(doc.alias("doc_id"), F.when(F.col("corrupt").isNull(), F.col("chunk_idx")).otherwise(chunk).alias("chunk_idx"), body.alias("body"), "path", "corrupt")
    message = F.when(F.col("corrupt").isNotNull(), F.substring("corrupt", 1, 100)).otherwise(F.lit("no doc_id"))
    return read.where("doc_id is not null").select("doc_id", "chunk_idx", "body"), read.where("doc_id is null").select("doc_id", "path", error_text(F.lit("CorruptRecord"), message).alias("error"))


def read_statement_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def split_failed(rows: DataFrame, statement: str = "statement_id", error: str = "row_error") -> tuple[DataFrame, DataFrame]:
    """Rows of statements without any error, and one row (statement, error_message) for each other statement."""
    from ..operators.windows import with_statement_error

    flagged = with_statement_error(rows, statement, error)
    failed = flagged.where("statement_error is not null").groupBy(statement).agg(F.max("statement_error").alias("error_message"))
    return flagged.where("statement_error is null").drop("statement_error", error), failed


def write_transactions(rows: DataFrame, path: str, quarantine: str, statement: str = "statement_id", error: str = "row_error") -> None:
    """Statement by statement: all rows go to the table, partitioned by month, or one error row to quarantine."""
    good, failed = split_failed(rows, statement, error)
    good.withColumn("year_month", F.date_format("date", "yyyy-MM")).write.mode("append").partitionBy("year_month").parquet(path)
    failed.write.mode("append").parquet(quarantine)


def statement_detail(statements: DataFrame, tx: DataFrame) -> DataFrame:
    """Statements with their transactions as a sorted array of structs; empty where there are none."""
    rows = tx.groupBy("statement_id").agg(F.sort_array(F.collect_list(F.struct("date", "id", "description", "amount", "currency"))).alias("transactions"))
    joined = statements.join(rows, statements["id"] == rows["statement_id"], "left").drop("statement_id")
    return joined.withColumn("n_transactions", F.coalesce(F.size("transactions"), F.lit(0)))


def raw_payload(*columns):
    """The columns as JSON, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
