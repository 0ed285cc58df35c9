"""Comparison of two clusterings of the same nodes, from one contingency table (sparse: cells that occur)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import clusters


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n): nodes in both; one join on the node and one aggregation."""
    joined = a.select("node_id", F.col("cluster_id").alias("a")).join(b.select("node_id", F.col("cluster_id").alias("b")), "node_id")
    return joined.groupBy("a", "b").agg(F.count("*").alias("n"))


def with_marginals(cells: DataFrame) -> DataFrame:
    rows, cols, all_n = cells.groupBy("a").agg(F.sum("n").alias("n_a")), cells.groupBy("b").agg(F.sum("n").alias("n_b")), cells.agg(F.sum("n").alias("n_all"))
    return cells.join(rows, "a").join(cols, "b").join(F.broadcast(all_n))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells with the % of either cluster that the other holds."""
    return with_marginals(contingency(a, b)).select("a", "b", "n", "n_a", "n_b", (F.col("n") / F.col("n_a") * 100).alias("pct_a"), (F.col("n") / F.col("n_b") * 100).alias("pct_b"))


def grid(a: DataFrame, b: DataFrame, k: int = 5) -> DataFrame:
    """The k largest clusters of either side against each other, empty cells included: k * k rows."""
    ta = clusters.top(a, k).select(F.col("cluster_id").alias("a"), F.col("size").alias("size_a"))
    tb = clusters.top(b, k).select(F.col("cluster_id").alias("b"))
    n = F.coalesce("n", F.lit(0))
    return ta.join(F.broadcast(tb)).join(contingency(a, b), ["a", "b"], "left").select("a", "b", n.alias("n"), (n / F.col("size_a") * 100).alias("pct_a"))


def report(a: DataFrame, b: DataFrame, more_than: int = 10, first: int = 20, largest: int = 10) -> DataFrame:
    """The largest overlaps of more than `more_than` nodes among the `largest` clusters of either side."""
    top = [F.broadcast(clusters.top(x, largest).select(F.col("cluster_id").alias(c))) for x, c in ((a, "a"), (b, "b"))]
    few = overlap(a, b).join(top[0], "a", "left_semi").join(top[1], "b", "left_semi").select("a", "b", "n", "n_a", "n_b", "pct_a", "pct_b")
    return few.where(F.col("n") > more_than).orderBy(F.desc("n"), "a", "b").limit(first)


def report_lines(a: DataFrame, b: DataFrame, threshold: float = 80.0) -> DataFrame:
    """(n, line): the report in Markdown, in order of n: overview, largest overlaps (from 10 on), the first 20 near-complete
    ones (from 100 on) and the variation of information (200)."""
    spark, long = a.sparkSession, lambda c: F.col(c).cast("long")
    fixed = [(0, "# Cluster overlap"), (5, "## Largest overlaps"), (6, "| a | b | shared | of a | of b |"), (7, "| --- | --- | --- | --- | --- |"), (99, "## Near-complete overlaps"), (199, "## Variation of information")]
    head = spark.createDataFrame(fixed, "n int, line string")
    counts = [x.agg(*agg) for x, agg in ((a, (F.count("*").alias("k"),)), (a, (F.count_distinct("cluster_id").alias("k"),)), (b, (F.count_distinct("cluster_id").alias("k"),)))]
    overview = [c.select(F.lit(i + 1).alias("n"), F.format_string(f"- {what}: %d", "k").alias("line")) for i, (c, what) in enumerate(zip(counts, ("nodes", "clusters of a", "clusters of b")))]
    w = Window.orderBy(F.desc("n"), "a", "b")  # over 20 rows
    body = report(a, b).select((F.row_number().over(w) + 9).alias("n"), F.format_string("| %d | %d | %d | %.1f%% | %.1f%% |", long("a"), long("b"), "n", "pct_a", "pct_b").alias("line"))
    order = ["direction", F.desc("pct"), "inner", "outer"]
    near = near_complete(a, b, threshold).orderBy(*order).limit(20)
    near = near.select((F.row_number().over(Window.orderBy(*order)) + 99).alias("n"), F.format_string("- %s: %d in %d, %d shared (%.1f%%)", "direction", long("inner"), long("outer"), "n", "pct").alias("line"))
    vi = information(a, b).select(F.lit(200).alias("n"), F.format_string("- %.3f nats", "vi_nats").alias("line"))
    for part in (*overview, body, near, vi):
        head = head.unionByName(part)
    return head


def near_complete(a: DataFrame, b: DataFrame, threshold: float = 80.0, least: int = 5) -> DataFrame:
    """Clusters of at least `least` nodes that the other side's cluster holds to `threshold` %, both ways."""
    o = overlap(a, b)
    way = lambda name, own, size, pct: o.where((F.col(size) >= least) & (F.col(pct) >= threshold)).select(F.lit(name).alias("direction"), F.col(own[0]).alias("inner"), F.col(own[1]).alias("outer"), "n", F.col(pct).alias("pct"))
    return way("a_in_b", "ab", "n_a", "pct_a").unionByName(way("b_in_a", "ba", "n_b", "pct_b"))


def shared_members(a: DataFrame, b: DataFrame, in_a: int, in_b: int) -> DataFrame:
    return a.where(F.col("cluster_id") == in_a).select("node_id").join(b.where(F.col("cluster_id") == in_b), "node_id", "left_semi")


def entropy(labels: DataFrame, base: float | None = None) -> DataFrame:
    """Entropy of the cluster sizes in nats, or to a base."""
    s = clusters.sizes(labels)
    p = F.col("size") / F.col("n")
    e = -F.sum(p * F.ln(p))
    return s.join(F.broadcast(s.agg(F.sum("size").alias("n")))).agg((e / F.ln(F.lit(base)) if base else e).alias("entropy"))


def information(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: entropies, mutual information, variation of information in nats and bits, conditional entropies.

    Cells that don't occur add nothing, and are not made.
    """
    c = with_marginals(contingency(a, b)).select((F.col("n") / F.col("n_all")).alias("p"), (F.col("n_a") / F.col("n_all")).alias("pa"), (F.col("n_b") / F.col("n_all")).alias("pb"))
    p, pa, pb = F.col("p"), F.col("pa"), F.col("pb")
    def minus(e):
        return F.negative(F.sum(e))

    return c.agg(
        minus(p * F.ln(pa)).alias("h_a"), minus(p * F.ln(pb)).alias("h_b"), F.sum(p * F.ln(p / (pa * pb))).alias("mutual_info"), minus(p * F.ln(p / pb)).alias("h_a_given_b"), minus(p * F.ln(p / pa)).alias("h_b_given_a"),
        minus(p * (F.ln(p / pa) + F.ln(p / pb))).alias("vi_nats"), F.abs(F.sum(p * (F.log2(p / pa) + F.log2(p / pb)))).alias("vi_bits"),
        minus(p * F.ln(p / (pb + 1e-10) + 1e-10)).alias("h_a_given_b_eps"), minus(p * F.ln(p / (pa + 1e-10) + 1e-10)).alias("h_b_given_a_eps"),
    )


def class_counts(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(cluster_id, class, n)."""
    return labels.join(classes, "node_id").groupBy("cluster_id", "class").agg(F.count("*").alias("n"))


def minority_members(labels: DataFrame, classes: DataFrame, fewer: int = 5) -> DataFrame:
    """(cluster_id, class, n, members): of clusters with several classes, those of fewer than `fewer` members, whose ids
    are listed."""
    cells = class_counts(labels, classes)
    mixed = cells.groupBy("cluster_id").agg(F.count("*").alias("k")).where("k > 1")
    few = cells.where(F.col("n") < fewer).join(mixed, "cluster_id", "left_semi")
    rows = labels.join(classes, "node_id").join(few, ["cluster_id", "class"])
    members = F.array_join(F.transform(F.array_sort(F.collect_list("node_id")), lambda x: x.cast("string")), ",")
    return rows.groupBy("cluster_id", "class", "n").agg(members.alias("members"))


def purity(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Per cluster of (node_id, cluster_id) against (node_id, class): points, classes, whether clean, the largest
    class's share and, in mixed clusters, how many classes have fewer than five members."""
    cells = class_counts(labels, classes)
    rare = F.when(F.count("*") > 1, F.count_if(F.col("n") < 5)).otherwise(0)
    return cells.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.count("*").alias("n_classes"), (F.count("*") == 1).alias("clean"), (F.max("n") / F.sum("n") * 100).alias("pct_major"), rare.alias("n_rare"))


def purity_summary(labels: DataFrame, classes: DataFrame) -> DataFrame:
    clean = F.col("clean")
    return purity(labels, classes).agg(
        F.count("*").alias("k"), F.count_if(clean).alias("clean_clusters"), (F.count_if(clean) / F.count("*") * 100).alias("pct_clean"), (F.sum(F.when(clean, F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("pct_points_clean")
    )


def never_confused(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes that share no cluster with another one."""
    cells = labels.join(classes, "node_id").select("cluster_id", "class").distinct()
    mixed = cells.groupBy("cluster_id").agg(F.count("*").alias("k")).where("k > 1")
    return classes.select("class").distinct().join(cells.join(mixed, "cluster_id", "left_semi"), "class", "left_anti")
