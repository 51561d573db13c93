"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs.  All but the last keep the columns of documents.

A document without text has no language, so the first stage drops it; null ids, languages and sources pass, a null
source is a site of its own.  Empty texts go with the first stage, too; of rows that repeat id and text one stays after
the third, and very long texts are worked on whole.  Ties are each operator's.  Empty tables give no rows.
"""

from tallyspark.llm import decontaminate, jaccard_join, langid, line_dedup, packing
from tallyspark.llm.shared import written


def language_id(spark, docs, sf_dir):
    """Documents whose language is told; those too far from every centroid, or without a letter, go."""
    model = langid.fit(docs.where(~langid.held_out()).select("lang", "text"))
    return langid.predict(docs, model).where("not rejected").select(*docs.columns)


def line_dedup_by_site(spark, docs, sf_dir):
    """Documents without their source's boilerplate lines."""
    return line_dedup.drop_boilerplate(docs, "source", "text")


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, n=5, percent=80)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents in which no benchmark item appears."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark, docs, sf_dir):
    """The pieces of the documents left and their places in sequences."""
    import public_tokenizers

    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep_ids=False)
    return packing.pack(cut).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_by_site),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("packing", best_fit_packing),
]

#: Language models and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
