"""Ingest: from replies about statement files to statements and postings, with the cards, aliases and merchants they make."""

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import currency_matches_variant, error_text, nonblank, parse_date, placeholder_holder, placeholder_mask, surrogate_key, variant_currency
from ..operators.extraction import check_replies, chunk_said, get_or_create_cards, merge_error, merged_chunks, parse_replies, typed_rows, with_currency_error
from ..operators.merchants import low_confidence, new_merchants, resolve_categories
from ..sources.snapshots import BUCKETS, Change, Snapshots
from ..sources.staging import staged

DATES = ("period_start", "period_end", "statement_date")
CURRENCIES = ("CLP", "USD")
CARD, FILE = ["bank_id", "card_number_masked", "cardholder"], ["bank_id", "file_path", "file_hash", "variant"]


def read_headers(h: DataFrame, as_of: date) -> DataFrame:
    """h, files with variant, file_hash and their merged chunks, with what their replies say of the statement, and an error.

    A file without chunks has failed too; a missing date is as_of, a missing currency that of the variant.
    """
    # parsed in a loop, as Java compiles no method as long as three of these written out
    h = h.withColumn("_dates", F.transform(F.array(*(F.col(f"metadata.{c}") for c in DATES)), parse_date))
    dates = {c: F.col("_dates")[k] for k, c in enumerate(DATES)}
    bad = F.concat_ws(", ", *(F.when(nonblank(F.col(f"metadata.{c}")).isNotNull() & parsed.isNull(), c) for c, parsed in dates.items()))
    broken = merge_error()
    error = (
        F.when(F.col("n_ok").isNull(), error_text(F.lit("ExtractionError"), F.lit("no chunks"))).when(broken.isNotNull(), broken)
        .when(variant_currency(F.col("variant")).isNull(), error_text(F.lit("IngestionError"), F.lit("no variant")))
        .when(~currency_matches_variant(F.col("metadata.currency"), F.col("variant")), error_text(F.lit("IngestionError"), F.lit("metadata currency is not the variant's")))
        .when(bad != "", error_text(F.lit("DateError"), bad))
    )
    card = {"card_number_masked": placeholder_mask(F.col("metadata.card_number_masked"), F.col("file_hash")), "cardholder": placeholder_holder(F.col("metadata.cardholder"), F.col("file_hash"))}
    return h.withColumns(card | {c: F.coalesce(parsed, F.lit(as_of)) for c, parsed in dates.items()} | {"error": error}).drop("_dates")


class Ingested:
    """statements, cards, aliases and merchants after the run, the run's own postings, and rejected (doc_id, error) files, which leave no statement.

    Each is worked out when it is asked for.  What is read of the files, their headers, the old cards by name, the files that are not new
    and what descriptions name are written once each, by the first that needs them, as several of the tables read them.
    """

    def __init__(self, payloads: DataFrame, files: DataFrame, statements: DataFrame, cards: DataFrame, aliases: DataFrame, merchants: DataFrame, categories: DataFrame, as_of: date):
        self._payloads, self._files, self._as_of, self._categories = payloads, files, as_of, categories
        self._old = {"statements": statements, "cards": cards, "aliases": aliases, "merchants": merchants}

    @cached_property
    def _read(self) -> DataFrame:
        """Each file's rows, typed, beside its header: leads marks one row of a file, which has no pos where the file has no row.

        Replies, rows and files meet in one task for each document, so they are dealt once, by doc_id, or not at all if they come so, and
        rows are sorted once.  error is the file's, error_message that of its rows.  Files of one doc_id are told apart by _file.
        """
        checked = check_replies(parse_replies(self._payloads.where("doc_id is not null"))).select("doc_id", "chunk_idx", chunk_said().alias("chunk"), F.posexplode_outer("reply.transactions").alias("pos", "t"))
        # a chunk is told of in its first row, which stays for that if it is a copy
        rows = checked.select("doc_id", "chunk_idx", "pos", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("chunk")).alias("chunk"), "t.*")
        typed = typed_rows(rows).withColumns({"_text": F.upper(F.trim("description")), "_sum": F.trim("amount")})
        # one order serves copies and whole documents
        same = ["date", "_text", "_sum"]
        copy = F.row_number().over(Window.partitionBy("doc_id", *same).orderBy("chunk_idx", "pos"))
        once = typed.withColumn("_n", copy).where("_n = 1 or chunk is not null").withColumn("pos", F.when(F.col("_n") == 1, F.col("pos")))
        ordered = Window.partitionBy("doc_id").orderBy(*same)
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        errors = {f"_{c}": F.max(F.when(F.col("pos").isNotNull(), with_currency_error(F.col("row_error"), c))).over(whole) for c in CURRENCIES}
        told = once.withColumns({"leads": F.row_number().over(ordered) == 1} | {n: c.over(whole) for n, c in merged_chunks("chunk").items()} | errors).where("leads or pos is not null")
        files = self._files.withColumn("_file", F.row_number().over(Window.partitionBy("doc_id").orderBy(*FILE))).withColumn("expected", variant_currency(F.col("variant")))
        both = files.join(told.drop("chunk", "row_error", "_n", *same[1:]), "doc_id", "left").withColumn("leads", F.coalesce("leads", F.lit(True)))
        failed = F.coalesce(*(F.when(F.col("expected") == c, F.col(f"_{c}")) for c in CURRENCIES))
        return staged(read_headers(both.withColumn("error_message", failed), self._as_of).select(
            "doc_id", "_file", "leads", "bank_id", "file_path", "file_hash", "expected", "card_number_masked", "cardholder", *DATES, "error", "error_message",
            "chunk_idx", "pos", "date", "description", "amount", "currency", "category", "parsed_date", "parsed_amount", "installment_number", "installment_total", "parsed_value",
        ))

    @cached_property
    def _headers(self) -> DataFrame:
        return staged(self._read.where("leads").select("doc_id", "_file", "bank_id", "file_path", "file_hash", F.col("expected").alias("currency"), "card_number_masked", "cardholder", *DATES, "error", "error_message"))

    @cached_property
    def rejected(self) -> DataFrame:
        return self._headers.where("error is not null").select("doc_id", "error")

    @cached_property
    def cards(self) -> DataFrame:
        return get_or_create_cards(self._old["cards"], self._headers.where("error is null"))

    @cached_property
    def _known(self) -> DataFrame:
        """The least id of each card there was."""
        return staged(self._old["cards"].groupBy(*CARD).agg(F.min("id").alias("_card"), F.lit(True).alias("_met")))

    def _owned(self, rows: DataFrame) -> DataFrame:
        """Rows of files that are not rejected, with the id of the card, which is a new one's if there is none of the name; one that lacks a name has no card."""
        named = rows.where("error is null").dropna(subset=CARD).join(self._known, CARD, "left")
        card = F.when(F.col("_met"), F.col("_card")).otherwise(surrogate_key(*CARD))
        return named.withColumn("credit_card_id", card).drop("_card", "_met")

    @cached_property
    def _stale(self) -> DataFrame:
        """Files that their card has had before, or takes from another of this run's."""
        key = ["credit_card_id", "file_hash"]
        place = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "_file"))
        there = self._old["statements"].select(*key, F.lit(True).alias("_there")).distinct()
        own = self._owned(self._headers).select("doc_id", "_file", *key)
        return staged(own.withColumn("_n", place).join(there, key, "left").where("_n > 1 or _there").select("doc_id", "_file"))

    def _fresh(self, rows: DataFrame) -> DataFrame:
        """Rows of files that make a statement, with its id."""
        return self._owned(rows).join(self._stale, ["doc_id", "_file"], "left_anti").withColumn("statement_id", surrogate_key("credit_card_id", "file_hash"))

    @cached_property
    def statements(self) -> DataFrame:
        status = F.when(F.col("error_message").isNull(), "completed").otherwise("failed")
        made = self._fresh(self._headers).select(F.col("statement_id").alias("id"), "credit_card_id", *DATES, "file_path", "file_hash", status.alias("status"), "error_message")
        return self._old["statements"].unionByName(made)

    @cached_property
    def _kept(self) -> DataFrame:
        return self._fresh(self._read.where("pos is not null and error_message is null"))

    @cached_property
    def _made(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What each description names, and the aliases and merchants that they make."""
        texts, old = staged(self._kept.select("description").distinct()), self._old
        named, aliases, merchants = new_merchants(texts, old["aliases"], old["merchants"], self._categories)
        merchants = staged(merchants)
        defaults = old["merchants"].unionByName(merchants).select(F.col("id").alias("merchant_id"), "default_category_id")
        return staged(named.join(defaults, "merchant_id", "left").select("description", "merchant_id", "alias_hit", "default_category_id")), aliases, merchants

    @cached_property
    def aliases(self) -> DataFrame:
        return self._old["aliases"].unionByName(self._made[1])

    @cached_property
    def merchants(self) -> DataFrame:
        return self._old["merchants"].unionByName(self._made[2])

    @cached_property
    def transactions(self) -> DataFrame:
        named = self._kept.withColumn("category", nonblank(F.col("category"))).join(self._made[0], "description")
        full = resolve_categories(named, self._categories)
        known = F.col("alias_hit") | F.col("merchant_id").isNull()
        return full.select(
            surrogate_key("statement_id", "chunk_idx", "pos").alias("id"), "statement_id", F.col("parsed_date").alias("date"), "description", F.col("parsed_amount").alias("amount"), F.col("expected").alias("currency"), F.col("category_label").alias("category"), "category_id",
            low_confidence(F.col("category_id").isNotNull(), known, F.col("default_category_id")).alias("low_confidence"), "merchant_id", "installment_number", "installment_total", F.col("parsed_value").alias("installment_value"),
            F.lit(None).cast("string").alias("recurring_rule_id"), F.to_json(F.struct("date", "description", "amount", "currency", "category")).alias("raw_json"),
        )


def ingest(payloads: DataFrame, files: DataFrame, statements: DataFrame, cards: DataFrame, aliases: DataFrame, merchants: DataFrame, categories: DataFrame, as_of: date) -> Ingested:
    """The ledger after files whose chunks were answered by payloads(doc_id, chunk_idx, body).

    A chunk whose reply breaks a rule counts as failed.  A card takes a file once, whatever became of it: of equal files
    the least doc_id.  One bad posting fails its statement, which then keeps its error and no posting, and makes no merchant.
    """
    return Ingested(payloads, files, statements, cards, aliases, merchants, categories, as_of)


def ingest_into(ledger: Snapshots, payloads: DataFrame, files: DataFrame, categories: DataFrame, as_of: date, refused: DataFrame | None = None, run: tuple[str, int] | None = None) -> int:
    """Commits what files and replies make of the ledger's last version: postings, statements with their status, cards, aliases, merchants and rejected files, all or nothing.

    Of the statements only the buckets of the files' hashes are read.  refused(doc_id, error): files that are rejected beside those the plan rejects.
    """
    base = ledger.version()
    # at most BUCKETS values
    buckets = [r[0] for r in files.select(F.pmod(F.xxhash64("file_hash"), F.lit(BUCKETS)).cast("string")).distinct().collect()]
    before = {n: ledger.read(n, base) for n in ("statements", "cards", "aliases", "merchants")}
    before["statements"] = before["statements"].where(F.col("bucket").isin(buckets)).drop("bucket")
    out = ingest(payloads, files, before["statements"], before["cards"], before["aliases"], before["merchants"], categories, as_of)
    changes = {n: Change(getattr(out, n).join(old.select("id"), "id", "left_anti")) for n, old in before.items()}
    rejected = out.rejected if refused is None else out.rejected.unionByName(refused)
    return ledger.commit(base, changes | {"transactions": Change(out.transactions), "rejected": Change(rejected)}, run)
