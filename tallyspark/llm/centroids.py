"""Centroid clustering of integer vectors, with the nearest centroid found by a tournament of bisectors.

Lloyd's rounds on vectors quantised to integers.  For each pair i < j of centroids the bisector is an integer
normal ``2 (c_j - c_i)`` and a threshold ``|c_j|^2 - |c_i|^2``: a vector whose product with the normal
does not exceed the threshold is as near to i as to j, or nearer, so zero favours the smaller number.  The first centroid meets
the second, the winner the third, and so on: k - 1 sign tests leave the nearest, and one
exact distance is computed in the end.  Products are exact: in 64-bit floats while they stay
below 2**53, in integers of any size beyond.

A round sums the vectors of each cluster where they are, so a task ships one row for each cluster, and a
cluster with a third of all vectors is no hot group.  Only centroids and sums of k rows reach the driver.

A vector is kept if it has ``dims`` components, none null or not finite; others have no row.  Components
are scaled and rounded down; those beyond 2**62 in size have no 64-bit value and are not kept either.  Repeated ids
and vectors are rows of their own; null ids start centroids after all others.  With fewer kept
vectors than k there are fewer centroids, without any no row.  A distance or an inertia beyond 64 bits is null.
Ties go to the smaller number.  Other columns pass through, whatever their names, but for those added.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .shared import row_of

#: Components of this size have exact products in 64-bit floats, for up to 256 of them.
SMALL = 1 << 21
LONG = (1 << 63) - 1
ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@dataclass
class Tournament:
    """Centroids, and the normals and thresholds of all their pairs."""

    centroids: list[list[int]]

    def __post_init__(self):
        c = np.array(self.centroids, object).reshape(len(self.centroids), -1)
        self.exact, square = c, (c * c).sum(axis=1)
        self.normals, self.thresholds = 2 * (c[None] - c[:, None]), square[None] - square[:, None]
        self.small = c.shape[1] <= 256 and max((abs(x) for x in c.ravel().tolist()), default=0) <= SMALL
        if self.small:
            self.normals, self.thresholds, self.floats = self.normals.astype(float), self.thresholds.astype(float), c.astype(float)

    def _nearest(self, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = (x * self.normals[best, j]).sum(axis=1) - self.thresholds[best, j]
            best = np.where(side > 0, j, best)
        gap = x - centroids[best]
        return best, (gap * gap).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Number of the nearest centroid of each vector, and the squared distance to it."""
        best, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
        small = (np.abs(x).max(axis=1, initial=0) <= SMALL) & self.small
        if small.any():
            best[small], far = self._nearest(x[small].astype(float), self.floats)
            distance[small] = [int(d) for d in far.tolist()]
        if not small.all():
            best[~small], distance[~small] = self._nearest(x[~small].astype(object), self.exact)
        return best, distance.tolist()


def quantised(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, dims)


def kept(vectors: DataFrame, vec_col: str, dims: int, scale: int) -> DataFrame:
    """Rows with a whole vector of finite components that fit 64 bits when scaled."""
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) >= float(1 << 62)))
    return vectors.where((F.size(vec_col) == dims) & ~F.coalesce(bad, F.lit(True)))


def seeds(rows: DataFrame, id_col: str, vec_col: str, k: int, seed: int, dims: int, scale: int) -> list[list[int]]:
    """The k kept vectors with the smallest hash of seed and id: k rows come to the driver."""
    hashed = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).alias("hash"), F.col(vec_col).cast("array<double>").alias("v"))
    first = hashed.orderBy(F.asc_nulls_last("hash"), F.col("v").cast("string")).limit(k).collect()
    return [np.floor(np.array(r["v"], np.float64) * scale).astype(np.int64).tolist() for r in first]


def _partial(of: np.ndarray, x: np.ndarray, distance: list[int], k: int):
    """count, sums of components and of distances of each cluster, as decimal strings."""
    for c in np.unique(of).tolist():
        own = of == c
        sums = x[own].astype(object).sum(axis=0) if np.abs(x[own]).max(initial=0) > SMALL else x[own].sum(axis=0)
        yield c, int(own.sum()), [str(s) for s in sums.tolist()], str(sum(d for d, o in zip(distance, own.tolist(), strict=True) if o))


def totals(rows: DataFrame, vec_col: str, tournament: Tournament, dims: int, scale: int) -> dict[int, tuple[int, list[int], int]]:
    """Count, sums of components and sum of distances of each cluster that has vectors: k rows at most, summed in each task first."""
    shared = rows.sparkSession.sparkContext.broadcast(tournament)

    def work(batches):
        total: dict = {}
        for batch in batches:
            x = quantised(batch.column("v"), dims, scale)
            of, distance = shared.value.nearest(x)
            for c, n, sums, far in _partial(of, x, distance, len(shared.value.centroids)):
                old = total.setdefault(c, [0, [0] * dims, 0])
                old[0], old[1], old[2] = old[0] + n, [a + int(b) for a, b in zip(old[1], sums, strict=True)], old[2] + int(far)
        if total:
            c = sorted(total)
            # a sum beyond 64 bits only has to stay so
            far = [str(min(total[k][2], LONG + 1)) for k in c]
            yield pa.record_batch([pa.array(c, pa.int32()), pa.array([total[k][0] for k in c]), pa.array([[str(s) for s in total[k][1]] for k in c]), pa.array(far)], ["cluster", "n", "sums", "far"])

    parts = rows.select(F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(work, "cluster int, n long, sums array<string>, far string")
    exact = parts.select("cluster", "n", F.transform("sums", lambda s: s.cast("decimal(38,0)")).alias("sums"), F.col("far").cast("decimal(38,0)").alias("far"))
    added = exact.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(d))).alias(f"s{d}") for d in range(dims)), F.sum("far").alias("far"))
    return {r["cluster"]: (r["n"], [int(r[f"s{d}"]) for d in range(dims)], int(r["far"])) for r in added.collect()}


def moved(centroids: list[list[int]], total: dict) -> list[list[int]]:
    """Centroids at the rounded-down means of their vectors; empty ones stay."""
    return [[s // total[c][0] for s in total[c][1]] if c in total else old for c, old in enumerate(centroids)]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """Kept vectors with cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 beside their other columns."""
    rows = kept(vectors, vec_col, dims, scale)
    centroids = seeds(rows, id_col, vec_col, k, seed, dims, scale)
    for _ in range(rounds if centroids else 0):
        centroids = moved(centroids, totals(rows, vec_col, Tournament(centroids), dims, scale))
    last = Tournament(centroids) if centroids else None
    total = totals(rows, vec_col, last, dims, scale) if last else {}
    fits = lambda x: x if x <= LONG else None
    shared = vectors.sparkSession.sparkContext.broadcast(last)
    others = rows.select(row_of(c for c in vectors.columns if c not in ADDED), F.col(vec_col).cast("array<double>").alias("v"))

    def assign(batches):
        for batch in batches:
            of, distance = shared.value.nearest(quantised(batch.column("v"), dims, scale))
            yield pa.record_batch([batch.column("row"), pa.array(of.astype(np.int32)), pa.array([fits(d) for d in distance], pa.int64())], ["row", "cluster", "distance"])

    schema = StructType().add("row", others.schema["row"].dataType).add("cluster", IntegerType()).add("distance", LongType())
    assigned = others.mapInArrow(assign, schema)
    # k rows at most
    table = [(c, fits(total[c][2]), fits(sum(t[2] for t in total.values())), ",".join(map(str, x))) for c, x in enumerate(centroids) if c in total]
    known = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid string")
    known = known.select("cluster", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(known), "cluster").select("row.*", *ADDED)


__all__ = ["cluster", "kept", "Tournament"]
