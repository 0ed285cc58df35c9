"""Quality of clusterings of vectors: (config, node_id, cluster_id) with vectors (node_id, v), or (config, node_id, v)
where each configuration has its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..storage import stored
from . import cells, clusters

ROWS = 512  # points whose distances are held at once
SAMPLE = 5000  # nodes that a silhouette is computed over at most, a feature of the metric


def sampled(labels: DataFrame, cap: int = SAMPLE, seed: int = 42) -> DataFrame:
    """At most `cap` rows of each configuration, in order of md5(node and seed).

    The first digits of an md5 are even, so those below a share that leaves twice `cap` rows and some more hold the first
    `cap`; only these are sorted.
    """
    key = F.md5(F.concat(F.col("node_id").cast("string"), F.lit(f"_{seed}")).cast("binary"))
    share = F.least(F.lit(1.0), (2 * cap + 100) / F.col("_n"))
    counts = labels.groupBy("config").agg(F.count("*").alias("_n"))
    few = labels.join(F.broadcast(counts), "config").withColumn("_k", key).where(F.conv(F.substring("_k", 1, 8), 16, 10).cast("long") <= share * (1 << 32)).drop("_n")
    w = Window.partitionBy("config").orderBy("_k", "node_id")
    return few.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= cap).drop("_i", "_k")


def _keys(points: DataFrame) -> list[str]:
    return ["config", "node_id"] if "config" in points.columns else ["node_id"]


def centroids(data: DataFrame) -> DataFrame:
    """(config, cluster_id, c)."""
    return vectors.averaged(data, ["config", "cluster_id"], "v", out="c")


def _mean_silhouette(x: np.ndarray, cluster: np.ndarray) -> float | None:
    """Distances of a block of points to all by a matrix product, summed per cluster."""
    _, of, sizes = np.unique(cluster, return_inverse=True, return_counts=True)
    k = len(sizes)
    if k < 2:
        return None
    square, total = (x * x).sum(1), 0.0
    for at in range(0, len(x), ROWS):
        rows = np.arange(at, min(at + ROWS, len(x)))
        d = np.sqrt(np.maximum(square[rows, None] + square[None] - 2 * (x[rows] @ x.T), 0))
        d[np.arange(len(rows)), rows] = 0
        sums = np.stack([np.bincount(of, weights=r, minlength=k) for r in d])
        own = of[rows]
        mine, others = sums[np.arange(len(rows)), own], sums / sizes
        others[np.arange(len(rows)), own] = np.inf
        a, b = mine / np.maximum(sizes[own] - 1, 1), others.min(1)
        top = np.maximum(a, b)
        s = np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0)
        total += float(np.where(sizes[own] > 1, s, 0.0).sum())  # alone in its cluster within the sample: 0
    return total / len(x)


def silhouette(labels: DataFrame, points: DataFrame, cap: int = SAMPLE) -> DataFrame:
    """Mean silhouette (Rousseeuw 1987, Euclidean) of each configuration over members of clusters that aren't single.

    At most `cap` nodes of a configuration take part, so one task holds its points and no pair becomes a row. Null below
    two clusters; nodes without a vector take no part.
    """
    several = labels.join(labels.groupBy("config", "cluster_id").agg(F.count("*").alias("m")).where("m > 1").select("config", "cluster_id"), ["config", "cluster_id"], "left_semi")
    data = sampled(several, cap).join(points.where("v is not null"), _keys(points)).select("config", "cluster_id", "v")
    kind = dict(labels.dtypes)["config"]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"config": pdf["config"].iloc[:1], "silhouette_score": [_mean_silhouette(np.array(pdf["v"].tolist(), float), pdf["cluster_id"].to_numpy())]})

    return data.groupBy("config").applyInPandas(score, f"config {kind}, silhouette_score double")


def _of_several(labels: DataFrame, points: DataFrame) -> DataFrame:
    several = labels.groupBy("config", "cluster_id").agg(F.count("*").alias("m")).where("m > 1").select("config", "cluster_id")
    return labels.join(several, ["config", "cluster_id"], "left_semi").join(points, _keys(points))


def _ratios(ca: np.ndarray, sa: np.ndarray, cb: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """For each cluster of the first block its largest (S_i + S_j) / distance over the second; 0 without one."""
    square = (ca * ca).sum(1)[:, None] + (cb * cb).sum(1)[None]
    d = np.maximum(square - 2 * (ca @ cb.T), 0)
    # Where the two nearly cancel out, from the differences themselves; equal centroids don't count.
    i, j = np.nonzero(d <= 1e-5 * square)
    for at in range(0, len(i), 1 << 16):
        k, m = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        d[k, m] = ((ca[k] - cb[m]) ** 2).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(d > 0, (sa[:, None] + sb[None]) / np.sqrt(d), 0.0)
    best, rows = r.argmax(1), np.arange(len(ca))
    d = np.sqrt(((ca - cb[best]) ** 2).sum(1))
    return np.where(r[rows, best] > 0, (sa + sb[best]) / np.where(d > 0, d, 1), 0.0)


def _worst(of: cells.Cells, wanted: np.ndarray, known: DataFrame | None = None) -> DataFrame:
    """(key, id, cell, r): the largest ratio of each cluster to those of the cells that are wanted for its own."""
    kinds = dict(of.rows.dtypes)

    def run(table: pa.Table) -> pa.Table:
        two = cells.sides(table)
        if two is None:
            return cells.nothing(table, {"cell": pa.int32(), "r": pa.float64()})
        (ids, c, s), (_, other, t) = two
        same = [table.column(n).combine_chunks().take(pa.array(np.zeros(len(ids), np.int64))) for n in ("key", "xc")]
        return pa.Table.from_arrays([same[0], pa.array(ids), same[1], pa.array(_ratios(c, s, other, t))], ["key", "id", "cell", "r"])

    found = cells.pairs(of, wanted).groupBy(*cells.PAIR).applyInArrow(run, f"key {kinds['key']}, id {kinds['id']}, cell int, r double")
    return (found if known is None else found.unionByName(known)).groupBy("key", "id", "cell").agg(F.max("r").alias("r"))


def _skipped(of: cells.Cells, least: pd.DataFrame, done: np.ndarray) -> np.ndarray:
    """Pairs of cells that can't raise any ratio of the first: (S + S') / (distance less radii) is no more than the
    least ratio that its clusters have already."""
    t = of.table.merge(least, "left", ["key", "cell"])
    which = t["cell"].to_numpy()
    gap = of.gaps()[which][:, which] - t["radius"].to_numpy()[:, None] - t["radius"].to_numpy()[None]
    gap = gap * (1 - cells.SLACK) - cells.SLACK
    top = t["top"].to_numpy()[:, None] + t["top"].to_numpy()[None]
    have = np.nan_to_num(t["least"].to_numpy(float))[:, None]
    return done | ((gap > 0) & (top <= have * np.where(gap > 0, gap, 1)))


def davies_bouldin(labels: DataFrame, points: DataFrame, pivots: int = cells.CELLS, block: int = cells.BLOCK, per_cell: int = cells.PER_CELL) -> DataFrame:
    """Mean over clusters of the largest (S_i + S_j) / distance of centroids (Davies and Bouldin 1979). Coincident
    centroids are left out of the maximum; null below two clusters, and where all centroids of a configuration coincide.

    Centroids are dealt around pivots; each block is first compared with its own cell and the nearest one, then with the
    cells that may still hold a larger ratio. A task holds two blocks, and pairs of centroids are never rows.
    """
    spark = labels.sparkSession
    data = _of_several(labels, points)
    c = centroids(data)
    spread = data.join(c, ["config", "cluster_id"]).groupBy("config", "cluster_id").agg(F.avg(vectors.euclidean("v", "c")).alias("s"))
    cs = stored(c.join(spread, ["config", "cluster_id"]))
    of = cells.dealt(cs, "config", "cluster_id", "c", "s", pivots, block, per_cell=per_cell)
    if not len(of.table):
        return labels.select("config").distinct().withColumn("davies_bouldin_score", F.lit(None).cast("double"))
    t = of.table
    which = t["cell"].to_numpy()
    gaps = of.gaps()[which][:, which]
    other = t["key"].to_numpy()[:, None] != t["key"].to_numpy()[None]
    near = np.eye(len(t), dtype=bool)
    far = np.where(other | near, np.inf, gaps)
    rows = np.flatnonzero(np.isfinite(far.min(1)))
    near[rows, far[rows].argmin(1)] = True
    first = stored(_worst(of, near))
    least = first.groupBy("key", "cell").agg(F.min("r").alias("least")).toPandas()  # a row for each cell
    rest = ~_skipped(of, least, near | other)
    found = first if not rest.any() else _worst(of, rest, first)
    score = found.where("r > 0").groupBy(F.col("key").alias("config")).agg(F.avg("r").alias("davies_bouldin_score"))
    return labels.select("config").distinct().join(score, "config", "left")


def calinski_harabasz(labels: DataFrame, points: DataFrame) -> DataFrame:
    """[B / (k - 1)] / [W / (n - k)] (Calinski and Harabasz 1974); null below two clusters or without dispersion."""
    data = _of_several(labels, points)
    c = centroids(data)
    all_c = vectors.averaged(data, ["config"], "v", out="g")
    square = lambda x, y: vectors.total(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)))
    within = data.join(c, ["config", "cluster_id"]).groupBy("config", "cluster_id").agg(F.count("*").alias("m"), F.sum(square("v", "c")).alias("w"))
    between = within.join(c, ["config", "cluster_id"]).join(all_c, "config").select("config", "m", "w", (F.col("m") * square("c", "g")).alias("b"))
    t = between.groupBy("config").agg(F.sum("b").alias("b"), F.sum("w").alias("w"), F.sum("m").alias("n"), F.count("*").alias("k"))
    score = F.try_divide(F.try_divide(F.col("b"), F.col("k") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("k")))
    return labels.select("config").distinct().join(t.select("config", score.alias("calinski_harabasz_score")), "config", "left")


def metrics(labels: DataFrame, points: DataFrame) -> DataFrame:
    """All figures of each configuration, one row each."""
    d = clusters.distribution(labels, ["config"]).withColumnRenamed("k", "n_clusters")
    return d.join(silhouette(labels, points), "config", "left").join(davies_bouldin(labels, points), "config", "left").join(calinski_harabasz(labels, points), "config", "left")


def scored(m: DataFrame) -> DataFrame:
    """Adds the six components, clamped to [0, 1], and their weighted sum. Missing figures count -1, 5 and 0."""
    sil, db, ch = (F.coalesce(c, F.lit(x)) for c, x in (("silhouette_score", -1.0), ("davies_bouldin_score", 5.0), ("calinski_harabasz_score", 0.0)))
    parts = {
        "quality": (sil + 1) / 2, "separation": F.greatest(F.lit(0.0), 1 - db / 5), "equality": 1 - F.col("gini_coefficient"),
        "efficiency": F.least(F.lit(1.0), F.col("top10_coverage") / F.least(F.lit(10), F.col("n_clusters")) / 10), "fragmentation": 1 - F.col("singleton_ratio") / 100, "calinski": F.least(F.lit(1.0), F.log1p(ch) / 10),
    }
    # The weights of the components in the order above.
    weights = [0.30, 0.20, 0.10, 0.10, 0.10, 0.20]
    total = sum((F.col(f"{n}_component") * w for n, w in zip(parts, weights)), F.lit(0.0))
    return m.withColumns({f"{n}_component": F.least(F.lit(1.0), F.greatest(F.lit(0.0), e)) for n, e in parts.items()}).withColumn("overall_score", total)


def leaderboard(m: DataFrame, first: int = 10) -> DataFrame:
    return scored(m).orderBy(F.desc("overall_score"), "config").limit(first)
