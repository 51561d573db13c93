r"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression follows a Boolean trigram query: an OR of the ANDs of the
trigrams that any match of an alternative must contain.  The query is read off the parsed
expression (``trigram_query``), so it can't drift from it.  The postings of those trigrams
(trigram, document) are intersected per document, which gives a rule's candidates.  Rules
without a mandatory trigram scan every document.  Candidates are verified by the expression
itself: the pieces between its matches and the matches give the spans.  Texts stay where they are
read: the candidates, some numbers each, are written and counted, and broadcast up to ``FEW`` of
them.  Beyond, a bitmap of bounded size tells which texts may be candidates, and those travel.

Rules are looked up in folded text, as letters of some match in either case.  The base kinds are
assign, access and hex; more rules add kinds of their own after them.  Null texts are empty and
empty texts have no span.  Very long texts are scanned whole.  Positions are code points, ends
exclusive; spans that start at one place come in the rules' order.  Repeated rows, and rows with
null or repeated ids, are scanned each on their own.  An empty table gives no row.  Columns beside
id and text are left out, whatever their names.
"""

from dataclasses import dataclass
from functools import cache, reduce
from re import _constants as C
from re import _parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: So many candidates are broadcast at most; bits of the bitmap beyond, as 4 KB rows of it.
FEW, BITS = 1 << 20, 1 << 27
#: Stands for any string in a form; most forms of an expression, and most letters of a set that are told apart.
GAP, FORMS, LETTERS = "\0", 64, 16


def _forms(pattern) -> list[str]:
    """Strings such that every match of a parsed expression is one of them, with some string for each gap."""
    out = [""]
    for op, arg in pattern:
        piece = _piece(op, arg)
        if len(out) * len(piece) > FORMS:
            piece = [GAP]
        out = [a + b for a in out for b in piece]
    return out


def _piece(op, arg) -> list[str]:
    if op is C.LITERAL:
        return [chr(arg).lower()]
    if op is C.IN:
        letters = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                letters.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < LETTERS:
                letters |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
            else:
                return [GAP]
        return sorted(letters) if len(letters) <= LETTERS else [GAP]
    if op is C.SUBPATTERN:
        return _forms(arg[-1])
    if op is C.BRANCH:
        return [x for branch in arg[1] for x in _forms(branch)]
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = arg
        if least == 0:
            return [*_forms(inner), ""] if most == 1 else [GAP]
        return [x + GAP * (most > 1) for x in _forms(inner)]
    if op is C.AT:
        return [""]
    return [GAP]


@cache
def trigram_query(regex: str) -> tuple[frozenset[str], ...]:
    """The Boolean trigram query of an expression as an OR of ANDs over folded text; empty if some match may have no trigram that is known."""
    ands = {frozenset(run[i : i + 3] for run in form.split(GAP) for i in range(len(run) - 2)) for form in _forms(_parser.parse(regex))}
    # an AND that asks for more than another adds nothing
    least = [a for a in ands if not any(b < a for b in ands)]
    return tuple(sorted(least, key=sorted)) if all(least) else ()


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: of the group's length, at least
    group: int = 0
    least: int = 1

    def query(self) -> tuple[frozenset[str], ...]:
        return trigram_query(self.regex)


# The three base kinds as their contract states them, then well-known token formats.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
#: Runs that the scan for a rule's matches can skip to, where its plain pattern matches almost everywhere.
SCAN = {"hex": r"[0-9a-f]{32,}+"}


def postings(rows: DataFrame, rules=RULES) -> DataFrame:
    """trigram, row: which rows contain the trigrams that the rules ask for."""
    wanted = sorted({t for r in rules for q in r.query() for t in q})
    folded = F.lower("text")
    there = F.filter(F.array(*(F.when(F.contains(folded, F.lit(t)), F.lit(t)) for t in wanted)), lambda t: t.isNotNull())
    return rows.select("row", F.explode(there).alias("trigram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """row, kinds: the numbers of the rules whose query a row's postings satisfy."""
    held = index.groupBy("row").agg(F.collect_set("trigram").alias("have"))
    kinds = []
    for number, r in enumerate(rules):
        if ors := r.query():
            met = [F.size(F.array_intersect("have", F.array(*map(F.lit, sorted(q))))) == len(q) for q in ors]
            kinds.append(F.when(reduce(lambda a, b: a | b, met), F.lit(number)))
    return held.select("row", F.filter(F.array(*kinds), lambda k: k.isNotNull()).alias("kinds")).where(F.size("kinds") > 0)


def _spans(rule: Rule, number: int, text):
    """Spans of a rule's matches whose group is long enough: array of (start, number, end)."""
    regex = F.lit(SCAN.get(rule.kind, rule.regex))
    between = F.transform(F.split(text, SCAN.get(rule.kind, rule.regex), -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length)
    group = whole if rule.group == 0 else F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), F.length)
    steps = F.arrays_zip(between.alias("gap"), whole.alias("match"), group.alias("group"))
    steps = F.filter(steps, lambda s: s["match"].isNotNull())
    empty = F.expr("cast(array() as array<struct<start:int, number:int, end:int>>)")
    first = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def add(acc, s):
        start = acc["at"] + s["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("number"), (start + s["match"]).alias("end")))
        return F.struct((start + s["match"]).alias("at"), F.when(s["group"] >= rule.least, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(steps, first, add, lambda a: a["spans"])


def met(rows: DataFrame, hits: DataFrame, few: int = FEW) -> DataFrame:
    """rows(row, ...) with the kinds of hits(row, kinds), null for rows that are no candidates."""
    if hits.count() <= few:
        return rows.join(F.broadcast(hits), "row", "left")
    bit = F.pmod("row", F.lit(BITS))
    bucket, place = F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)
    # at most BITS / 2^15 + 1 rows of 4 KB
    bitmap = hits.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    asked = rows.withColumn("bucket", bucket).join(F.broadcast(bitmap), "bucket", "left")
    told = asked.withColumn("may", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)))
    home = told.where("not may").select(*rows.columns, F.lit(None).cast(hits.schema["kinds"].dataType).alias("kinds"))
    return home.unionByName(told.where("may").select(*rows.columns).join(hits, "row", "left"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, few: int = FEW) -> DataFrame:
    """id_col and found: array of (start, number of the rule, end) by start and rule, a row for each row of docs.

    Rows meet their candidacy by id and text hash; where both are equal, so is the candidacy.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("id", "text"))
    both = met(rows, written(candidates(postings(rows, rules), rules)), few)
    parts = []
    empty = F.expr("cast(array() as array<struct<start:int, number:int, end:int>>)")
    for number, rule in enumerate(rules):
        may = F.coalesce(F.array_contains("kinds", number), F.lit(False)) if rule.query() else F.col("text").rlike(SCAN.get(rule.kind, rule.regex))
        parts.append(F.when(may, _spans(rule, number, F.col("text"))).otherwise(empty))
    return both.select(F.col("id").alias(id_col), F.array_sort(F.concat(*parts)).alias("found"))


def joined(found, rules=RULES):
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["number"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, few: int = FEW) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs, id_col, text_col, rules, few)
    base = F.filter("found", lambda s: s["number"] < len(BASE))

    def count(k):
        return F.size(F.filter("found", lambda s: s["number"] == k)).cast("long")

    return found.select(id_col, *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)), F.sha2(joined(base, rules), 256).alias("base_sha256"), joined(F.col("found"), rules).alias("spans"))
