"""From model replies to rows: parsing, checking, merging of chunks, and statements that are new."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.text import completeness, error_text, nonblank, parse_amount, parse_date, placeholder_holder, placeholder_mask, reply_content, strip_fence, surrogate_key, valid_confidence, valid_currency
from ..sources.model import EXTRACTION, ROWS

# How long the fields of a reply's row may be; those from 1 on must be there.
LENGTHS = {"date": (1, 10), "description": (1, 500), "amount": (1, 64), "currency": (3, 3), "category": (0, 50), "installment_value": (0, 64)}
#: Characters of a body that a pattern may show to be a reply; longer ones are parsed to VARIANT, which has a limit of its own.
BARE = 1_000_000
NONE = "cast(array() as array<string>)"


def plain_shape(schema: str) -> str:
    """A pattern of JSON objects with keys of the schema alone, on every level; it tells no others from text that is no JSON.

    Its loops are possessive, so it runs in one pass and without recursion.
    """
    text, scalar = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r"[-+.\w]++"

    def of(kind):
        if isinstance(kind, StructType):
            fields = "|".join(rf'"{f.name}"\s*+:\s*+{of(f.dataType)}' for f in kind.fields)
            return rf"(?:\{{(?:[\s,]*+(?:{fields}))*+\s*+\}}|null)"
        if isinstance(kind, ArrayType):
            return rf"(?:\[(?:[\s,]*+{of(kind.elementType)})*+\s*+\]|null)"
        return rf"(?:{text}|{scalar})"

    return rf"^\s*+{of(_struct(schema))}\s*+$"


def ordered_shape(schema: str) -> str:
    """A pattern of JSON objects that have keys of the schema alone, on every level each once at most and in its order, the first one always.

    Unlike plain_shape it takes valid JSON only, so what it takes need not be parsed to be known as such; numbers are of 18 digits at most.
    """
    ws, hexa = r"[ \t\n\r]*+", "[0-9a-fA-F]"
    text = rf'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u{hexa}{{4}})[^"\\\x00-\x1f]*+)*+"'
    scalar = rf"(?:{text}|-?+(?:0|[1-9]\d{{0,17}}+)(?:\.\d{{1,18}}+)?+(?:[eE][-+]?+\d{{1,2}}+)?+|true|false|null)"

    def of(kind, whole=False):
        if isinstance(kind, StructType):
            fields = [rf'(?:"{f.name}"{ws}:{ws}{of(f.dataType)}{ws}(?:,{ws}(?=")|(?=\}})))' + ("" if whole and not k else "?+") for k, f in enumerate(kind.fields)]
            inside = rf"\{{{ws}{''.join(fields)}\}}"
            return inside if whole else rf"(?:{inside}|null)"
        if isinstance(kind, ArrayType):
            return rf"(?:\[{ws}(?:{of(kind.elementType)}{ws}(?:,{ws}(?=[^\]])|(?=\])))*+\]|null)"
        return scalar

    return rf"^{ws}{of(_struct(schema), True)}{ws}\z"


def _struct(schema: str) -> StructType:
    return StructType.fromDDL(schema.removeprefix("struct<").removesuffix(">"))


def parse_replies(payloads: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, reply (null where it can't be parsed), extra (keys on any level that no reply has), error.

    A body that is a reply in the schema's order is its own content and has no other keys.  Of others, the envelope is
    parsed to VARIANT, and so is its content unless its shape shows that it has the schema's keys alone: keys are seen
    before a schema drops them.  Steps that are read more than once have columns of their own, as an expression within
    another one is evaluated as often as it is written there.
    """
    body, content, bare = F.col("body"), F.col("_content"), F.col("_bare")
    known = payloads.withColumn("_bare", F.coalesce((F.length(body) <= BARE) & body.rlike(ordered_shape(EXTRACTION)), F.lit(False)))
    opened = known.withColumn("_envelope", F.when(~bare, F.try_parse_json(body))).withColumn("_text", F.when(~bare, reply_content(F.col("_envelope"), body)))
    inside = opened.withColumn("_content", F.when(bare, body).otherwise(strip_fence(F.col("_text"))))
    variant = F.when(content == body, F.col("_envelope")).otherwise(F.try_parse_json(content))
    parsed = inside.withColumn("_r", F.from_json("_content", EXTRACTION)).withColumn("_all", F.when(~bare & ~content.rlike(plain_shape(EXTRACTION)), variant))
    ok = F.col("_r.transactions").isNotNull() | F.col("_r.metadata").isNotNull()
    return parsed.select("doc_id", "chunk_idx", F.when(ok, F.col("_r")).alias("reply"), F.when(F.col("_all").isNotNull(), extra_keys(F.col("_all"))).otherwise(F.expr(NONE)).alias("extra"), F.when(~F.coalesce(ok, F.lit(False)), F.lit("no valid reply")).alias("error"))


def clean_rows(reply):
    """The reply's rows that have a description and an amount."""
    return F.filter(reply["transactions"], lambda t: (F.trim(t["description"]) != "") & (F.trim(t["amount"]) != ""))


def clean_metadata(reply):
    """The reply's metadata without currencies there are not; other missing fields are blank."""
    meta = reply["metadata"]
    names = ("card_number_masked", "cardholder", "currency", "period_start", "period_end", "statement_date")
    currency = F.when(valid_currency(meta["currency"]), meta["currency"])
    full = F.struct(*((currency if f == "currency" else F.coalesce(meta[f], F.lit(""))).alias(f) for f in names))
    return F.when(meta.isNotNull(), full)


def _length_outside(field, low, high):
    return lambda t: ~F.coalesce(F.length(t[field]), F.lit(0)).between(low, high)


def violations(reply):
    """Names of the rules that a reply breaks."""
    rows = reply["transactions"]
    rules = {
        "metadata": reply["metadata"].isNull(),
        "confidence": ~F.coalesce(valid_confidence(reply["confidence"]), F.lit(False)),
        **{f"{f} length": F.exists(rows, _length_outside(f, *bounds)) for f, bounds in LENGTHS.items()},
        "instalments": F.exists(rows, lambda t: (t["installment_number"] < 1) | (t["installment_total"] < 1)),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))


def unbroken(reply):
    """Whether a reply breaks no rule, from one pass over its rows."""
    def fine(t):
        long = reduce(lambda a, b: a | b, (_length_outside(f, *bounds)(t) for f, bounds in LENGTHS.items()))
        return ~(long | F.coalesce((t["installment_number"] < 1) | (t["installment_total"] < 1), F.lit(False)))

    return reply["metadata"].isNotNull() & F.coalesce(valid_confidence(reply["confidence"]), F.lit(False)) & F.coalesce(F.forall(reply["transactions"], fine), F.lit(False))


def check_replies(parsed: DataFrame) -> DataFrame:
    """parsed with cleaned replies; one that breaks a rule after that, or has keys of its own, is null and its error names what it breaks."""
    reply = F.col("reply")
    rows = F.coalesce(clean_rows(reply), F.array().cast(ROWS))
    clean = F.when(reply.isNotNull(), F.struct(rows.alias("transactions"), clean_metadata(reply).alias("metadata"), reply["confidence"].alias("confidence"), reply["notes"].alias("notes")))
    c = parsed.withColumn("reply", clean)
    names = F.concat_ws(", ", F.array_union(violations(F.col("reply")), F.transform("extra", lambda k: F.concat(F.lit("extra "), k))))
    # rules are named only where one is broken
    c = c.withColumn("_broken", F.when(F.col("reply").isNotNull(), F.when((F.size("extra") == 0) & unbroken(F.col("reply")), "").otherwise(names)))
    valid = F.col("_broken") == ""
    return c.withColumn("error", F.when(F.col("_broken") != "", error_text(F.lit("ValidationError"), F.col("_broken"))).otherwise(F.col("error"))).withColumn("reply", F.when(valid, F.col("reply"))).drop("_broken")


def extra_keys(reply, schema: str = EXTRACTION):
    """Keys of a VARIANT reply that the schema does not have, as a, metadata.a or transactions.a, each once."""
    top, none = _struct(schema), F.expr(NONE)
    def beyond(keys, fields, prefix=""):
        other = F.array_except(F.coalesce(keys, none), F.array(*map(F.lit, fields)))
        return F.transform(other, lambda k: F.concat(F.lit(prefix), k))

    found = [beyond(F.map_keys(F.try_variant_get(reply, "$", "map<string,variant>")), top.names)]
    for f in top.fields:
        if isinstance(f.dataType, StructType):
            found.append(beyond(F.map_keys(F.try_variant_get(reply, f"$.{f.name}", "map<string,variant>")), f.dataType.names, f"{f.name}."))
        elif isinstance(f.dataType, ArrayType):
            rows = F.try_variant_get(reply, f"$.{f.name}", "array<map<string,variant>>")
            found.append(beyond(F.flatten(F.transform(rows, F.map_keys)), f.dataType.elementType.names, f"{f.name}."))
    return F.concat(*found)


def merge_chunks(parsed: DataFrame) -> DataFrame:
    """A row for each document: confidence and notes of the first good chunk, the most complete metadata, chunks that went well or not, and an error."""
    ok = F.col("reply").isNotNull()
    first = F.min_by(F.struct("reply.confidence", "reply.notes"), F.when(ok, F.col("chunk_idx")))
    got = parsed.withColumn("_chunk", chunk_said()).groupBy("doc_id").agg(first.alias("first"), *(c.alias(n) for n, c in merged_chunks("_chunk").items()))
    return got.select("doc_id", "first.confidence", "first.notes", "metadata", "n_ok", "n_failed", merge_error().alias("error"))


def chunk_said():
    """What merged_chunks reads of a chunk: ok, metadata and how complete that is."""
    ok, metadata = F.col("reply").isNotNull(), F.col("reply.metadata")
    return F.struct(ok.alias("ok"), metadata.alias("metadata"), F.when(ok, completeness(metadata)).otherwise(0).alias("score"))


def merged_chunks(chunk: str) -> dict:
    """Aggregates over a document's chunks, of which each has chunk_said in one row: the most complete metadata, and how many went well or not."""
    ok, score = F.col(f"{chunk}.ok"), F.col(f"{chunk}.score")
    best = F.max_by(f"{chunk}.metadata", F.when(score > 0, F.struct(score, -F.col("chunk_idx"))))
    return {"metadata": best, "n_ok": F.count_if(ok), "n_failed": F.count_if(~ok)}


def merge_error():
    """What is wrong with a document's merged chunks."""
    return F.when(F.col("n_ok") == 0, error_text(F.lit("ExtractionError"), F.lit("all chunks failed"))).when(F.col("metadata").isNull(), error_text(F.lit("ExtractionError"), F.lit("no metadata")))


def extracted_rows(parsed: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, pos and the fields of every cleaned row.

    An outer explode, as Spark would put the test of an inner one below the parsing, which then ran twice.
    """
    rows = parsed.select("doc_id", "chunk_idx", F.posexplode_outer(clean_rows(F.col("reply"))).alias("pos", "t"))
    return rows.where("pos is not null").select("doc_id", "chunk_idx", "pos", "t.*")


def typed_rows(rows: DataFrame, default_currency: str = "CLP", expected=None) -> DataFrame:
    """Rows with parsed date, amount and value of an instalment, and row_error where one fails or the currency isn't the expected column's.

    What is parsed comes out of a generator of one row, so a test of it is not put below the parsing, which then ran twice.
    """
    currency = F.coalesce("currency", F.lit(default_currency))
    value = F.col("installment_value") if "installment_value" in rows.columns else F.lit(None).cast("string")
    parsed = F.struct(parse_date(F.col("date")).alias("parsed_date"), parse_amount(F.col("amount"), currency).alias("parsed_amount"), parse_amount(nonblank(value), currency).alias("parsed_value"))
    out = rows.select("*", F.inline_outer(F.array(parsed)))
    bad = F.when(F.col("parsed_date").isNull(), error_text(F.lit("DateError"), F.coalesce("date", F.lit(""))))
    bad = bad.when(F.col("parsed_amount").isNull(), error_text(F.lit("AmountError"), F.coalesce("amount", F.lit("")))).when(nonblank(value).isNotNull() & F.col("parsed_value").isNull(), error_text(F.lit("AmountError"), value))
    return out.withColumn("row_error", bad if expected is None else with_currency_error(bad, expected, default_currency))


def with_currency_error(error, expected, default_currency: str = "CLP"):
    """error of a row, or that its currency is not the expected one."""
    currency = F.coalesce("currency", F.lit(default_currency))
    return F.when(~F.coalesce(currency == expected, F.lit(False)), error_text(F.lit("CurrencyError"), currency)).otherwise(error)


def new_statements(headers: DataFrame, existing: DataFrame) -> DataFrame:
    """Headers whose card and file are not there in any status, once each."""
    return headers.join(existing.select("credit_card_id", "file_hash"), ["credit_card_id", "file_hash"], "left_anti").dropDuplicates(["credit_card_id", "file_hash"])


def get_or_create_cards(cards: DataFrame, headers: DataFrame) -> DataFrame:
    """cards with those of headers(bank_id, card_number_masked, cardholder, currency, file_hash) that are new by bank, mask and holder."""
    h = headers.withColumn("card_number_masked", placeholder_mask(F.col("card_number_masked"), F.col("file_hash"))).withColumn("cardholder", placeholder_holder(F.col("cardholder"), F.col("file_hash")))
    key = ["bank_id", "card_number_masked", "cardholder"]
    new = h.groupBy(*key).agg(F.min("currency").alias("currency")).join(cards, key, "left_anti")
    return cards.unionByName(new.select(surrogate_key(*key).alias("id"), *key, "currency", F.lit(True).alias("is_active")), allowMissingColumns=True)
