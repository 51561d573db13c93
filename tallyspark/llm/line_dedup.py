"""Line dedup by site-relative frequency, in DataFrame functions only.

A host's boilerplate are the lines that more than ``ratio`` of its pages contain, on
``min_pages`` pages at least.  Pages count a line once, before anything is shuffled, and the
counts are aggregated where they arise, so a host with a third of all pages is no hot group.
Pages are counted in the same pass, as one more line that every page has; lines meet their host's number of
pages by host and salt, so a host with most of the lines is not one task either.
As a page has few lines, a host has at most its mean number of lines over ``ratio`` such lines.
The lists of all hosts are written and their lines counted: up to ``BROADCAST`` lines they are sent
to where the pages are, so texts stay in place; beyond it pages meet them by host and one of as
many salts as there are partitions, so the pages of a large host are not one group.  Lines are
named by 64-bit hashes within their host.

A null host is a host of its own.  A null text stays null and its page does not count.  Lines
without a visible character are never dropped.  Repeated rows, and rows with null or repeated ids,
are pages of their own.  A line on exactly ``ratio`` of the pages stays.  Very long texts are taken
whole.  An empty table stays empty.  Other columns pass through, whatever their names, but for
n_lines and n_dropped, which ``counts`` replaces.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, row_of, written

#: Lines of 8 bytes.
BROADCAST = 1 << 20
SALTS = 32
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url):
    """The lower-case host of a url column; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, HOST, 1), F.lit("")))


def _visible(line):
    return F.length(F.translate(line, " \t\r\x0b\x0c", "")) > 0


def boilerplate(docs: DataFrame, host, text, ratio: float, min_pages: int) -> DataFrame:
    """_host, _lines: hashes of the lines to drop, for hosts that have any."""
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), _visible), lambda x: F.xxhash64(x)))
    # a page's last line is null and counts the page; the outer explode keeps Spark from testing, and so computing, the lines before
    marked = docs.where(text.isNotNull()).select(host.alias("_host"), F.explode_outer(F.array_append(lines, F.lit(None).cast("long"))).alias("_line"))
    seen = written(marked.groupBy("_host", "_line").agg(F.count("*").alias("_n")).where((F.col("_n") >= min_pages) | F.col("_line").isNull()))
    total = seen.where("_line is null").select(F.col("_host").alias("_of"), F.col("_n").alias("_pages"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rest = seen.where("_line is not null").withColumn("_salted", F.pmod("_line", F.lit(SALTS)).cast("int"))
    often = rest.join(total, rest["_host"].eqNullSafe(total["_of"]) & (rest["_salted"] == total["_salt"])).where(F.col("_n") > ratio * F.col("_pages")).select("_host", "_line")
    return often.groupBy("_host").agg(F.sort_array(F.collect_list("_line")).alias("_lines"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 3, counts: bool = False, broadcast: int = BROADCAST) -> DataFrame:
    """docs with its boilerplate lines dropped from text_col; with counts, also n_lines and n_dropped."""
    host, text = F.col(host_col), F.col(text_col)
    drop = written(boilerplate(docs, host, text, ratio, min_pages))
    size = drop.agg(F.sum(1 + F.size("_lines"))).first()[0] or 0
    lines, gone = F.split(F.col("_row")[text_col], "\n"), F.col("_lines")
    kept = F.filter(lines, lambda x: ~(_visible(x) & F.array_contains(gone, F.xxhash64(x))))
    rows = docs.select(row_of(docs.columns, "_row"))
    met = rows["_row"][host_col].eqNullSafe(drop["_host"])
    if size <= broadcast:
        both = rows.join(F.broadcast(drop), met, "left")
    else:
        salts = partitions(docs.sparkSession)
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col("_row")[text_col]), F.lit(salts)))
        salted = drop.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        both = rows.join(salted, rows["_row"][host_col].eqNullSafe(salted["_host"]) & (rows["_salt"] == salted["_of"]), "left")
    out = both.select("_row", F.when(gone.isNull(), F.col("_row")[text_col]).otherwise(F.array_join(kept, "\n")).alias("_text"), F.size(lines).alias("_n"), F.when(gone.isNull(), 0).otherwise(F.size(lines) - F.size(kept)).alias("_gone"))
    columns = [F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    extra = [F.when(F.col("_row")[text_col].isNull(), 0).otherwise(F.col("_n")).alias("n_lines"), F.when(F.col("_row")[text_col].isNull(), 0).otherwise(F.col("_gone")).alias("n_dropped")] if counts else []
    return out.select(*columns, *extra)
