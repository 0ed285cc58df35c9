"""Size distribution of cluster assignments (node_id, cluster_id).

Everything is derived from the table of cluster sizes; `by` columns, such as a configuration, keep several clusterings
apart. Ties in size go to the smaller cluster id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import distinct_colour, muted_colour
from .ranking import numbered


def sizes(labels: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    return labels.groupBy(*by, "cluster_id").agg(F.count("*").alias("size"))


def ranked(labels: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Sizes with their rank; a clustering may have nearly as many clusters as nodes."""
    return numbered(sizes(labels, by).withColumn("_down", -F.col("size")), ["_down", "cluster_id"], by).drop("_down")


def summary(labels: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    n = [F.count_if(F.col("size") >= k).alias(f"ge{k}") for k in (10, 50, 100)]
    return sizes(labels, by).groupBy(*by).agg(
        F.sum("size").alias("n"), F.count("*").alias("k"), F.avg("size").alias("avg_size"), F.median("size").alias("median_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.count_if(F.col("size") == 1).alias("singletons"), *n
    )


def point_summary(labels: DataFrame) -> DataFrame:
    """Mean, median, extremes, % of points in singletons and the ten largest sizes."""
    s = sizes(labels)
    top = F.slice(F.sort_array(F.collect_list("size"), asc=False), 1, 10)
    top10 = s.orderBy(F.desc("size")).limit(10).agg(top.alias("top10"))
    return s.agg(F.avg("size").alias("avg_size"), F.median("size").alias("median_size"), F.max("size").alias("max_size"), F.min("size").alias("min_size"), (F.count_if(F.col("size") == 1) / F.sum("size") * 100).alias("pct_points_single")).join(top10)


def distribution(labels: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Coverage of the k largest clusters, Gini coefficient, singleton and largest-cluster ratios.

    Clusters of equal size are counted together, so the ranks that the Gini coefficient needs are made over the few
    distinct sizes, not over clusters.
    """
    same = sizes(labels, by).groupBy(*by, "size").agg(F.count("*").alias("m"))
    up = Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    r = same.withColumn("below", F.coalesce(F.sum("m").over(up), F.lit(0))).withColumn("above", F.coalesce(F.sum("m").over(down), F.lit(0)))
    # The ranks of m clusters of one size after `below` smaller ones add up to m * below + m (m + 1) / 2.
    ranks = F.col("m") * F.col("below") + F.col("m") * (F.col("m") + 1) / 2
    n, k = F.sum(F.col("m") * F.col("size")), F.sum("m")
    covered = [(F.sum(F.least(F.col("m"), F.greatest(F.lit(0), F.lit(t) - F.col("above"))) * F.col("size")) / n * 100).alias(f"top{t}_coverage") for t in (1, 5, 10, 20)]
    gini = 2 * F.sum(ranks * F.col("size")) / (k * n) - (k + 1) / k
    singles = F.sum(F.when(F.col("size") == 1, F.col("m")).otherwise(0))
    return r.groupBy(*by).agg(n.alias("n"), k.alias("k"), *covered, gini.alias("gini_coefficient"), (singles / k * 100).alias("singleton_ratio"), (F.max("size") / n * 100).alias("mega_cluster_ratio"))


def size_buckets(labels: DataFrame) -> DataFrame:
    s = F.col("size")
    name = F.when(s == 1, "singleton").when(s < 10, "2-9").when(s < 50, "10-49").when(s < 100, "50-99").otherwise("100+")
    return sizes(labels).groupBy(name.alias("bucket")).agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_points"))


def categories(labels: DataFrame, large: int = 10) -> DataFrame:
    s = F.col("size")
    return sizes(labels).withColumn("category", F.when(s >= large, "large").when(s >= 5, "medium").otherwise("small"))


def colours(labels: DataFrame, large: int = 10) -> DataFrame:
    """(cluster_id, size, category, colour): clusters of at least `large` members have distinct colours, largest first,
    those of at least 5 muted ones, counted anew, and smaller ones are grey."""
    c = categories(labels, large).withColumn("_down", -F.col("size"))
    counts = c.groupBy("category").agg(F.count("*").alias("_k"))
    own = numbered(c, ["_down", "cluster_id"], ["category"]).join(F.broadcast(counts), "category")
    base = distinct_colour(F.col("rank") - 1, F.col("_k"))
    colour = F.when(F.col("category") == "large", base).when(F.col("category") == "medium", muted_colour(base)).otherwise("#d3d3d3")
    return own.select("cluster_id", "size", "category", colour.alias("colour"))


def top(labels: DataFrame, k: int) -> DataFrame:
    return sizes(labels).orderBy(F.desc("size"), "cluster_id").limit(k)


def shares(labels: DataFrame, k: int = 8) -> DataFrame:
    """The k largest clusters with their % of all points."""
    all_points = labels.agg(F.count("*").alias("n"))
    return top(labels, k).join(F.broadcast(all_points)).select("cluster_id", "size", (F.col("size") / F.col("n") * 100).alias("share"))


def cumulative_coverage(labels: DataFrame) -> DataFrame:
    all_points = labels.agg(F.count("*").alias("n"))
    own = numbered(sizes(labels).withColumn("_down", -F.col("size")), ["_down", "cluster_id"], total="size")
    return own.join(F.broadcast(all_points)).select("rank", "cluster_id", "size", (F.col("running") / F.col("n") * 100).alias("coverage"))


def needed_for(labels: DataFrame, pct: float = 80.0) -> DataFrame:
    """The clusters that it takes to hold pct % of the points."""
    return cumulative_coverage(labels).where(F.col("coverage") >= pct).agg(F.min("rank").alias("clusters_needed"))


def power_law(labels: DataFrame, k: int = 20, least: int = 11) -> DataFrame:
    """OLS of log10(size) on log10(rank) over the k largest clusters; nulls below `least` clusters."""
    few = top(labels, k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "cluster_id")))  # k rows
    r = few.select(F.log10("size").alias("y"), F.log10("rank").alias("x"))
    fit = r.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("m"))
    return fit.select(*[F.when(F.col("m") >= least, F.col(c)).alias(c) for c in ("slope", "intercept", "r2")])


def members(labels: DataFrame, first: int = 10, names: DataFrame | None = None) -> DataFrame:
    """Size and the first members of each cluster; `names` (node_id, video_id) defaults to video_<node>.

    Numbered within a cluster before they are collected, so that no list grows beyond `first`.
    """
    w = Window.partitionBy("cluster_id").orderBy("node_id")
    few = labels.withColumn("i", F.row_number().over(w)).where(F.col("i") <= first)
    if names is not None:
        few = few.join(names, "node_id", "left")
    name = F.concat(F.lit("video_"), F.col("node_id").cast("string"))
    name = F.coalesce("video_id", name) if names is not None else name
    lists = few.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("node_id", name.alias("name")))).alias("m"))
    return sizes(labels).join(lists, "cluster_id").select("cluster_id", "size", F.array_join(F.transform("m", lambda x: x["name"]), ",").alias("members"))


def non_singletons(labels: DataFrame) -> DataFrame:
    """Rows whose cluster has other members. The sizes are joined, so that a hot cluster needn't fit one task."""
    return labels.join(sizes(labels).where("size > 1").select("cluster_id"), "cluster_id", "left_semi")


def box_stats(labels: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Quartiles, mean and whiskers (within 1.5 interquartile ranges) of cluster sizes."""
    s = sizes(labels, by)
    q = s.groupBy(*by).agg(F.percentile("size", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.avg("size").alias("mean"))
    q = q.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "mean").withColumn("reach", 1.5 * (F.col("q3") - F.col("q1")))
    inside = F.col("size").between(F.col("q1") - F.col("reach"), F.col("q3") + F.col("reach"))
    joined = s.join(F.broadcast(q), by) if by else s.join(F.broadcast(q))
    return joined.where(inside).groupBy(*by, "q1", "q2", "q3", "mean").agg(F.min("size").alias("low"), F.max("size").alias("high"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins from the least to the largest value, the last one closed; empty bins have 0. Equal values
    all fall into the first bin."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).cast("int")
    counts = df.select(value).join(F.broadcast(ends)).where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("c"))
    all_bins = ends.where("lo is not null").select("lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("c", F.lit(0)).alias("n"))
