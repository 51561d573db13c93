"""Queries over whole tables, one for each operator, and their SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, fill_in_middle, jaccard_join, langid, line_dedup, packing, quality, secret_scan, substring_dedup, suffix_array, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(substring_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), width=50))


def op2_jaccard_join(spark, sf_dir):
    found = jaccard_join.linked_documents(table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op3_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_line_dedup(spark, sf_dir):
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op6_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()).select("lang", "text"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_decontaminate(spark, sf_dir):
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.count("*").alias("n_regions"), F.min("edits").alias("edits"), F.min("start").alias("first_start"), F.min("end").alias("first_end"))


def op8_packing(spark, sf_dir, tokenizer=None):
    import public_tokenizers

    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep_ids=False)
    return packing.pack(cut).select(F.col("doc").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset"))


def op9_toxicity(spark, sf_dir):
    def fold(c):
        return F.pmod(F.crc32(c.cast("string")), F.lit(4))

    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold)
    return found.select(F.col("doc").alias("doc_id"), F.coalesce(F.col("fold") == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_secret_scan(spark, sf_dir):
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op11_suffix_array(spark, sf_dir):
    left = suffix_array.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark, sf_dir):
    made = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hashed = (F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{c}_sha256") for c in ("output", "restored"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)


def op13_centroids(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_jaccard_join, op3_quality, op4_warc, op5_line_dedup, op6_langid, op7_decontaminate, op8_packing, op9_toxicity, op10_secret_scan, op11_suffix_array, op12_fill_in_middle, op13_centroids, pipeline)}

WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

FOLDED = WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

#: The secret scan's expressions as SQL takes them, with the group whose length counts and its least length.
SECRETS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
    ("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
]


def _secret_spans(k, kind, regex, group, least) -> str:
    q = regex.replace("'", "''")
    return f"""select doc_id, {k} as k, '{kind}' as kind, b + ends[i] - lens[i] as s, b + ends[i] as e from (
select doc_id, i, lens, list_transform(range(1, len(lens) + 1), lambda j: list_sum(lens[1:j])) as ends, list_sum(list_transform(ps[1:i], lambda x: length(x))) as b, gs
from (select doc_id, ps, gs, list_transform(ms, lambda x: length(x)) as lens, unnest(range(1, len(ms) + 1)) as i
from (select doc_id, regexp_split_to_array(t, '{q}') as ps, regexp_extract_all(t, '{q}') as ms, regexp_extract_all(t, '{q}', {group}) as gs from d where regexp_matches(t, '{q}')))) where length(gs[i]) >= {least}"""


def _clusters(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """Every round's centroids (c) and its vectors' nearest (a)."""
    parts = [
        f"v as (select vec_id, list_transform(embedding, lambda x: cast(floor({dims} * cast(x as double)) as bigint)) as x from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: isfinite(x))) = {dims})",
        f"c0 as (select row_number() over (order by h) - 1 as k, x as c from (select sha256('1:' || vec_id) as h, x from v order by h limit {k}))",
    ]
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(rounds + 1):
        parts.append(f"a{i} as (select vec_id, x, m.k as k, m.d as d from (select vec_id, x, arg_min({{'k': k, 'd': d}}, row(d, k)) as m from (select vec_id, x, k, cast({far} as bigint) as d from v cross join c{i}) group by vec_id, x))")
        if i < rounds:
            parts.append(f"m{i} as (select k, list((s - ((s % n) + n) % n) // n order by i) as m from (select k, i, cast(sum(x[i]) as bigint) as s, count(*) as n from (select k, x, unnest(range(1, {dims + 1})) as i from a{i}) group by k, i) group by k)")
            parts.append(f"c{i + 1} as (select c{i}.k, coalesce(m, c) as c from c{i} left join m{i} on m{i}.k = c{i}.k)")
    return ",\n".join(parts)


SQL = {
    "op2_jaccard_join": f"""
with recursive w as (select doc_id, {FOLDED} as ws from documents),
s as (select distinct doc_id, md5(array_to_string(ws[i:i + 2], ' ')) as h from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as met from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * met >= 90 * (x.n + y.n - met)),
e as (select a, b from l union all select b, a from l),
r as (select distinct a as doc_id, a as reached from e union select r.doc_id, e.b from r join e on r.reached = e.a),
c as (select doc_id, min(reached) as least from r group by doc_id)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(c.least, w.doc_id) as component_id from w left join n using (doc_id) left join c using (doc_id)""",
    "op10_secret_scan": f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({" union all ".join(_secret_spans(k, *x) for k, x in enumerate(SECRETS))}),
g as (select doc_id, count_if(k = 0) as n_assign, count_if(k = 1) as n_access, count_if(k = 2) as n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (where k < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans from f group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc_id)""",
    "op1_substring_dedup": f"""
with w as (select doc_id, {WORDS} as ws from documents),
s as (select doc_id, ws, unnest(generate_series(1, len(ws) - 49)) as i from w where len(ws) >= 50),
k as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as h from s),
m as (select h, min(doc_id) as low from k group by h),
g as (select distinct doc_id, unnest(generate_series(i, i + 49)) as p from k join m using (h) where low < doc_id),
gone as (select doc_id, list(p) as ps, count(*) as n from g group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: not coalesce(list_contains(ps, i), false)), ' ')) as kept_sha256
from w left join gone using (doc_id)""",
    "op4_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b) as n, sha1(b) as d from p),
r as (select *, max(page_id) over (partition by d, n) as last from q)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when n >= 1000 and last <> page_id then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and last <> page_id then last end as refers_to
from r""",
    "op5_line_dedup": """
with l as (select doc_id, source, text, string_split(text, chr(10)) as ls from documents where text is not null),
e as (select distinct doc_id, source, unnest(ls) as line from l),
v as (select * from e where length(translate(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ', '')) > 0),
pages as (select source, count(*) as pages from l group by source),
b as (select source, line from (select source, line, count(*) as n from v group by source, line) join pages using (source) where n >= 3 and n > 0.1 * pages),
h as (select source, list(line) as drop_lines from b group by source),
k as (select doc_id, ls, list_filter(ls, lambda x: not coalesce(list_contains(drop_lines, x), false)) as kept from l left join h using (source))
select doc_id, cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(kept) as bigint) as n_dropped, sha256(array_to_string(kept, chr(10))) as kept_sha256 from k
union all select doc_id, 0, 0, null from documents where text is null""",
    "op11_suffix_array": """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
k as (select doc_id, i, md5(substring(x, 2 * i + 1, 400)) as h from (select doc_id, x, unnest(range(0, len(x) // 2 - 199)) as i from t)),
m as (select h from k group by h having count(*) > 1),
g as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from k semi join m using (h)),
n as (select doc_id, i, sum(case when before is null or i > before + 200 then 1 else 0 end) over (partition by doc_id order by i) as run from g),
r as (select doc_id, min(i) as s, max(i) + 200 as e from n group by doc_id, run),
p as (select *, coalesce(lag(e) over (partition by doc_id order by s), 0) as from_ from r),
a as (select doc_id, count(*) as n_spans, sum(e - s) as n_removed, max(e) as stop, string_agg(substring(x, 2 * from_ + 1, 2 * (s - from_)), '' order by s) as kept from p join t using (doc_id) group by doc_id)
select doc_id, cast(len(x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept, '') || substring(x, 2 * coalesce(stop, 0) + 1))) as kept_sha256
from t left join a using (doc_id)""",
    "op12_fill_in_middle": """
with t as (select doc_id, coalesce(text, '') as t, sha256('1:' || doc_id) as h from documents),
d as (select *, length(t) as n, list_transform([1, 2, 3, 4], lambda k: cast('0x' || substring(h, 8 * k - 7, 8) as bigint)) as r from t),
f as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 90 then 'plain' when r[4] % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (select *, substring(t, 1, a) as x, substring(t, a + 1, b - a) as y, substring(t, b + 1) as z from f)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y when 'spm' then '<S>' || z || '<P>' || x || '<M>' || y else t end) as output_sha256, sha256(x || y || z) as restored_sha256
from p""",
    "op13_centroids": f"""
with {_clusters()},
r as (select vec_id, cast(k as integer) as cluster, d as distance, k from a3)
select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256 from r join c3 using (k)""",
}
