"""Connected components of a graph given as a table of edges."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import remove, write


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that edges lead to) for every node of edges(a, b).

    Alternating large-star and small-star steps: each works on the minima of neighbourhoods,
    which are aggregated before they are shuffled, and every round is written to the shared
    folder in place of the one before.  Rounds go on until one changes nothing; their
    number grows with the logarithm of the longest path.  Repeated edges and loops count for nothing; without edges there is no row.
    """
    spark = edges.sparkSession

    def kept(df):
        """df written, and what tells it from another: counted while it is written."""
        seen = Observation()
        table, path = write(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("key")))
        return table, path, seen.get

    e, path, state = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = e.select("a", "b").union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its lower neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        before, (e, at, now) = path, kept(small)
        remove(spark, before)
        path = at
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b")).distinct()
        state = now
