"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least_neighbour(links: DataFrame) -> DataFrame:
    """For each u the least of itself and its neighbours; partial sums keep a hot u cheap."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link.

    `links` has columns u and v, in either direction, repeats allowed. Each round is stored in the shared folder; the
    joins are many-to-one, so that Spark can split a hot node. Rounds grow with the logarithm of the largest chain;
    RuntimeError after `most` rounds rather than a wrong answer.
    """
    spark = links.sparkSession
    paths = [common.shared_dir(spark)]
    now = common.stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), paths[0])
    before = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = _least_neighbour(down)
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        paths.append(common.shared_dir(spark))
        now = common.stored(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), paths[-1])
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if len(paths) > 2:
            common.dropped(spark, paths.pop(0))
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components: no end after {most} rounds")
