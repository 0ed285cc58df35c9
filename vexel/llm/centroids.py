"""Centroid clustering over distinct quantised vectors.

Vectors become whole numbers, and equal ones one row with their multiplicity, so a vector that a third of all rows hold
costs one distance. Lloyd's rounds go over the distinct vectors: each partition gives a row of whole-number sums for
each centroid, which Spark adds up, so results don't hang on the order of the rows. Assignments are joined back to ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Larger components could give squared distances that a long doesn't hold.
LARGEST = 1 << 27
ROWS = 4096  # vectors whose distances are held at once


def quantised(vectors: DataFrame, id_col: str = "vec_id", v: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q array<int>): floor(scale * x) of each component x as a double.

    Left out are vectors that are null, of another length than `dims`, with a null, infinite or NaN component, or with one
    beyond LARGEST once quantised. Null ids and repeated rows stay.
    """
    q = F.transform(F.col(v), lambda x: F.floor(x.cast("double") * scale))
    fits = (F.size(v) == dims) & F.coalesce(F.forall(F.col(v), lambda x: F.coalesce(F.abs(x.cast("double")) * scale <= LARGEST, F.lit(False)) & ~F.isnan(x.cast("double"))), F.lit(False))
    return vectors.where(F.col(v).isNotNull() & fits).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(q, lambda x: x.cast("int")).alias("q"))


def weighted(rows: DataFrame) -> DataFrame:
    """(q, w): each distinct vector and how many rows hold it."""
    return rows.groupBy("q").agg(F.count("*").alias("w"))


def first_centroids(rows: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `<seed>:<vec_id>`; all, if they are fewer. Null ids come last; of equal
    hashes the smaller vector comes first."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r.q) for r in rows.select(key.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()]


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and its squared distance, for whole numbers."""
    best, least = np.zeros(len(q), np.int64), None
    for c, centre in enumerate(centroids):
        gap = q - centre
        d = np.einsum("ij,ij->i", gap, gap)
        closer = d < least if least is not None else np.ones(len(q), bool)
        best[closer] = c
        least = d if least is None else np.where(closer, d, least)
    return best, least


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(distinct: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(cluster, k, s): the weighted sum of component k over the vectors of each cluster, and for k = -1 their weight."""
    centres = np.array(centroids, np.int64)
    count, dims = centres.shape

    def run(batches):
        sums, seen = [[0] * (dims + 1) for _ in range(count)], False
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                q, w = _matrix(part.column(0), dims), part.column(1).to_numpy()
                own, _ = nearest(q, centres)
                wide = (np.abs(q).max(initial=0) + 1) * int(w.sum()) >= 1 << 62
                q, w = (q.astype(object), w.astype(object)) if wide else (q, w)
                for c in np.unique(own):
                    of = own == c
                    total = (q[of] * w[of, None]).sum(0)
                    sums[c] = [a + int(b) for a, b in zip(sums[c], [w[of].sum(), *total])]
                    seen = True
        if seen:
            cluster = np.repeat(np.arange(count), dims + 1)
            yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(np.tile(np.arange(-1, dims), count), pa.int32()), pa.array([str(x) for s in sums for x in s])], ["cluster", "k", "s"])

    parts = distinct.select("q", "w").mapInArrow(run, "cluster int, k int, s string")
    return parts.groupBy("cluster", "k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def moved(distinct: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid's componentwise floor(sum / count) over its vectors; one without vectors stays. What comes to the
    driver is a number for each centroid and component."""
    sums = {(r.cluster, r.k): int(r.s) for r in _sums(distinct, centroids).collect()}
    return [[sums[c, k] // sums[c, -1] for k in range(len(old))] if sums.get((c, -1)) else old for c, old in enumerate(centroids)]


def assigned(distinct: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """distinct (q, w) with `cluster` and squared `distance`."""
    centres = np.array(centroids, np.int64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                own, d = nearest(_matrix(part.column(0), centres.shape[1]), centres)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.int32()), pa.array(d, pa.int64())], ["q", "w", "cluster", "distance"])

    return distinct.select("q", "w").mapInArrow(run, "q array<int>, w long, cluster int, distance long")


def fitted(distinct: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    return centroids


def clustered(vectors: DataFrame, id_col: str = "vec_id", v: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each kept vector.

    See quantised() for which vectors are kept, first_centroids() for the start. Distances are squared, inertia is their
    sum over all rows of a cluster or of the table. No kept vectors give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, v, dims, scale)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    start = first_centroids(rows, k, seed)
    if not start:
        return spark.createDataFrame([], out)
    distinct = common.stored(weighted(rows))
    centroids = fitted(distinct, start, rounds)
    found = common.stored(assigned(distinct, centroids))
    # One row for each cluster.
    per = found.groupBy("cluster").agg(F.sum(F.col("w").cast("decimal(19,0)") * F.col("distance")).alias("s"))
    total = per.agg(F.sum("s").cast("long").alias("inertia"))
    digests = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)], "cluster int, centroid_sha256 string")
    facts = per.select("cluster", F.col("s").cast("long").alias("cluster_inertia")).join(F.broadcast(digests), "cluster").join(F.broadcast(total))
    # Many rows to one distinct vector: Spark can split the side of a frequent one. The hash goes first, as vectors
    # are slow to compare.
    key = F.xxhash64("q").alias("h")
    joined = rows.select("vec_id", "q", key).join(found.select("q", "cluster", "distance", key), ["h", "q"])
    return joined.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
