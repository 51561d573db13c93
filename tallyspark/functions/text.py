"""Cleaning and parsing of statement text, as Column expressions."""

from functools import reduce
from unicodedata import combining, normalize

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def _folds() -> dict[str, str]:
    """Latin letters, ligatures and full-width forms that compatibility decomposition without marks turns into ASCII."""
    blocks = [*range(0xA1, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]
    plain = {chr(i): "".join(c for c in normalize("NFKD", chr(i)) if not combining(c)) for i in blocks}
    return {c: x for c, x in plain.items() if x.strip() and x.isascii()}


FOLDS = _folds()
ACCENTED = "".join(c for c, x in FOLDS.items() if len(x) == 1)
#: Combining marks, which a letter written apart from its accent leaves behind.
MARKS = "".join(map(chr, range(0x300, 0x370)))
# Legal forms and branch words that name no merchant.
LEGAL = r"(?i)(?<!\w)(?:S\.A\.C\.|S\.A\.|SpA|LTDA|CIA|SUCURSAL|SUC|COM)(?!\w)"
# Section headers of the two statement variants.
HEADERS = ("ESTADO DE CUENTA NACIONAL", "ESTADO DE CUENTA EN MONEDA NACIONAL", "ESTADO DE CUENTA INTERNACIONAL")
SECTION_MARKS = ("INFORMACIÓN DE TRANSACCIONES", "PERÍODO ACTUAL", "DETALLE DE OPERACIONES", "DETALLE", "TRANSACCIONES")


#: Chunks of a document that Python hands on at once.
CHUNKS = 1000


def fold_accents(c: Column) -> Column:
    """c with letters for their accented, joined or full-width forms; other scripts stay."""
    x = F.translate(c, ACCENTED + MARKS, "".join(FOLDS[a] for a in ACCENTED))
    several = {a: b for a, b in FOLDS.items() if len(b) > 1}
    joined = reduce(lambda y, ab: F.replace(y, F.lit(ab[0]), F.lit(ab[1])), several.items(), x)
    return F.when(x.rlike("[" + "".join(several) + "]"), joined).otherwise(x)


@F.pandas_udf(StringType())
def decompose(texts: pd.Series) -> pd.Series:
    """The ASCII left of each text after full compatibility decomposition: circled, Roman-numeral and mathematical letters too."""
    return texts.map(lambda t: None if t is None else normalize("NFKD", t).encode("ascii", "ignore").decode())


def normalize_merchant(c: Column, exact: bool = False) -> Column:
    """The canonical key of a description: legal forms, punctuation and digits go, instalment marks such as 03/06 stay.

    exact decomposes every character that Unicode can, in Python: for distinct descriptions.  Without it, Latin letters,
    ligatures and full-width forms are folded by expressions alone.
    """
    folded = decompose(c) if exact else F.regexp_replace(fold_accents(c), r"[^\x00-\x7F]", "")
    x = F.regexp_replace(folded, LEGAL, " ")
    x = F.regexp_replace(x, r"(\d+/\d+)|[;.,/]|\d", "$1\x01")
    x = F.regexp_replace(F.regexp_replace(x, "(\\d+/\\d+)\x01", "$1"), "\x01+", " ")
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def parse_amount(c: Column, currency: Column) -> Column:
    """decimal(15,2) from local notation: points group thousands, a comma starts the cents of USD; null if it isn't an amount."""
    # up to the first US$, then up to the first $, everything goes
    before, groups = r"(?s)^(?>.*?US\$)?+(?>[^$]*\$)?+\s*", r"([+-]?\s*\d+(?:\.\d{3})*"
    code = F.upper(F.trim(currency))
    x = F.when(code == "CLP", F.regexp_extract(c, before + groups + r")\s*$", 1)).when(code == "USD", F.regexp_extract(c, before + groups + r"(?:,\d{1,2})?)\s*$", 1))
    return F.translate(x, ",.+ \t\r\n\x0b\x0c", ".").try_cast("decimal(15,2)")


def parse_date(c: Column) -> Column:
    """A date from DD/MM/YYYY, DD/MM/YY (70 and above in the last century) or YYYY-MM-DD; null if it isn't one."""
    day, month, year, short = (F.substring(c, at, n) for at, n in ((1, 2), (4, 2), (7, 4), (7, 2)))
    dated = lambda *parts: F.concat_ws("-", *parts).try_cast("date")
    century = F.when(short >= "70", "19").otherwise("20")
    slashed = F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), dated(year, month, day)).when(c.rlike(r"^\d{2}/\d{2}/\d{2}$"), dated(F.concat(century, short), month, day))
    return F.coalesce(slashed, F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}\z"), c.try_cast("date")))


def date_status(c: Column) -> Column:
    """blank, ok or bad."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "blank").when(parse_date(c).isNotNull(), "ok").otherwise("bad")


def detect_variant(text: Column) -> Column:
    """NACIONAL or INTERNACIONAL by the header that comes first; null without any."""
    up = F.upper(text)
    at = [F.nullif(F.locate(h, up), F.lit(0)) for h in HEADERS]
    home, abroad = F.least(at[0], at[1]), at[2]
    return F.when(home.isNotNull() & (abroad.isNull() | (home < abroad)), "NACIONAL").when(abroad.isNotNull(), "INTERNACIONAL")


def _after(text: Column, mark: str) -> Column:
    """1-based position of the first occurrence, if beyond the first 100 characters."""
    at = F.instr(text, mark)
    return F.when(at > 101, at)


def strip_other_variant(text: Column, variant: Column) -> Column:
    """The text without the other variant's section."""
    at = F.coalesce(_after(text, HEADERS[2]), _after(text, "INTERNACIONAL"))
    home = F.when(at.isNotNull(), F.substring(text, F.lit(1), at - 1)).otherwise(text)
    abroad = F.when(at.isNotNull(), F.concat(F.substring(text, 1, 500), F.substring(text, at, F.length(text)))).otherwise(text)
    return F.when(variant == "NACIONAL", home).when(variant == "INTERNACIONAL", abroad).otherwise(text)


def section_start(text: Column, marks=SECTION_MARKS) -> Column:
    return F.coalesce(*(_after(text, m) for m in marks))


def truncate_text(text: Column, variant: Column, limit: int = 5000) -> Column:
    x = strip_other_variant(text, variant)
    start = F.coalesce(section_start(x), F.lit(1))
    return F.when(F.length(x) <= limit, x).otherwise(F.substring(x, start, F.lit(limit)))


def chunk_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5000, overlap: int = 200, variant: Column | None = None) -> DataFrame:
    """id, chunk_idx, chunk: windows that end at a line end in their second half where there is one, each starting ``overlap`` before the last end.

    With a variant, the other variant's section goes first; a null variant keeps the text.
    """
    def cut(text: str) -> list[str]:
        if text is None:
            return []
        out, at = [], 0
        while True:
            end = min(len(text), at + size)
            if end < len(text):
                line = text.rfind("\n", at + size // 2 - 1, end)
                end = line + 1 if line >= 0 else end
            out.append(text[at:end])
            if end >= len(text):
                return out
            at = max(end - overlap, at + 1)

    text = F.col(text_col) if variant is None else strip_other_variant(F.col(text_col), variant)
    rows = docs.select(F.col(id_col), text.alias("_text"))
    key = rows.schema[0]
    out = StructType([key, StructField("chunk_idx", IntegerType()), StructField("chunk", StringType())])

    def chunks(batches):
        for batch in batches:
            # a document at a time, so Python never holds the chunks of a whole batch
            for i in range(batch.num_rows):
                cuts = cut(batch.column(1)[i].as_py())
                for at in range(0, len(cuts), CHUNKS):
                    part = cuts[at : at + CHUNKS]
                    ids = batch.column(0).take(pa.array([i] * len(part)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(range(at, at + len(part)), pa.int32()), pa.array(part, pa.string())], names=out.names)

    return rows.mapInArrow(chunks, out)


def completeness(meta: Column, fields=("card_number_masked", "cardholder", "currency", "period_start", "period_end", "statement_date")) -> Column:
    return reduce(lambda a, b: a + b, (F.when(F.trim(meta[f].cast("string")) != "", 1).otherwise(0) for f in fields))


def error_text(kind: Column, message: Column) -> Column:
    x = F.translate(F.concat(kind, F.lit(": "), message), "\r\n", "  ")
    return F.when(F.length(x) > 500, F.concat(F.substring(x, 1, 499), F.lit("…"))).otherwise(x)


def surrogate_key(*columns) -> Column:
    return F.sha2(F.concat_ws("\x1f", *columns), 256)


def alias_key(c: Column) -> Column:
    return fold_accents(F.lower(F.trim(c)))


def strip_fence(c: Column) -> Column:
    """The inside of a Markdown code fence without its outer blanks, or the text itself."""
    blanks = F.lit(" \t\n\x0b\x0c\r")
    untagged = lambda t: F.when(t.startswith("json") | t.startswith("JSON"), F.substring(t, F.lit(5), F.length(t))).otherwise(t)
    inside = lambda t: F.btrim(_once(F.substring(t, F.lit(4), F.length(t) - 6), untagged), blanks)
    fenced = lambda t: F.when(t.startswith("```") & t.endswith("```") & (F.length(t) >= 6), inside(t))
    # most texts have no fence, and null is not one
    return F.when(c.contains("```"), F.coalesce(_once(F.btrim(c, blanks), fenced), c)).otherwise(c)


def _once(c: Column, f) -> Column:
    """f of c, which is evaluated once however often f reads it."""
    return F.transform(F.array(c), f)[0]


def reply_content(envelope: Column, body: Column) -> Column:
    """The content of a reply: in choices, in message, in text blocks, or the body itself.  envelope is the body as a VARIANT, parsed once."""
    get = lambda path, kind="string": F.try_variant_get(envelope, path, kind)
    blocks = get("$.content", "array<struct<type string, text string>>")
    joined = F.nullif(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), ""), F.lit(""))
    own = F.when(get("$.transactions", "variant").isNotNull() | get("$.notes", "variant").isNotNull(), body)
    return F.coalesce(get("$.choices[0].message.content"), get("$.choices[0].content"), get("$.message.content"), joined, get("$.content"), own)


def percent_change(now: Column, before: Column) -> Column:
    """One decimal; null where there was nothing before."""
    return F.when(before != 0, F.round(((now - before) / before * 100).cast("double"), 1))


def canonical_name(notes: Column, first_description: Column, raw: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (notes, first_description)), raw)


def placeholder_mask(mask: Column, file_hash: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(mask), F.lit("")), F.concat(F.lit("UNKNOWN-"), F.substring(file_hash, 1, 8)))


def placeholder_holder(holder: Column, file_hash: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(holder), F.lit("")), F.concat(F.lit("UNKNOWN CARDHOLDER ("), F.substring(file_hash, 1, 8), F.lit(")")))


def sane_confidence(c: Column) -> Column:
    """NaN and infinities are 0; other values stay, and those outside 0..1 are for valid_confidence to refuse."""
    return F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), 0.0).otherwise(c)


def valid_confidence(c: Column) -> Column:
    return sane_confidence(c).between(0.0, 1.0)


def valid_currency(c: Column) -> Column:
    return c.isin("CLP", "USD")


def nonblank(c: Column) -> Column:
    """c, or null where nothing is written."""
    return F.when(F.trim(c) != "", c)


def variant_currency(variant: Column) -> Column:
    return F.when(variant == "NACIONAL", "CLP").when(variant == "INTERNACIONAL", "USD")


def currency_matches_variant(currency: Column, variant: Column) -> Column:
    return currency == variant_currency(variant)


def classify_period(days: Column) -> Column:
    return F.when(days <= 10, "weekly").when(days <= 18, "biweekly").when(days <= 45, "monthly").when(days <= 120, "quarterly").otherwise("yearly")
