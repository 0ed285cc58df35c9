"""Ranks and running sums over all rows without one task for them all."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def numbered(df: DataFrame, order: list[str], by: list[str] = [], total: str | None = None) -> DataFrame:  # noqa: B006
    """Adds `rank`, from 1 in ascending order of the columns `order` within each `by`, and with `total` the running sum of
    that column as `running`.

    Rows are dealt into ranges of (by, order), one for each shuffle partition; a range ranks its own rows, and a small
    table has what stands before it. The bounds of the ranges are sampled once and stored, as every branch of the plan
    must see the same. Equal rows share a range, so `order` should tell rows apart. Nulls are a value of `by` like any
    other, and come first in `order`.
    """
    spark, key = df.sparkSession, F.struct(*by, *order)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lows = df.select(*by, *order).repartitionByRange(n, *by, *order).groupBy(F.spark_partition_id().alias("_p")).agg(F.min(key).alias("_low"))
    bounds = stored(lows).agg(F.collect_list("_low").alias("_bounds"))  # one row of n bounds at most
    ranged = df.join(F.broadcast(bounds)).withColumn("_r", F.size(F.filter("_bounds", lambda b: b <= key))).drop("_bounds")
    sums = ranged.groupBy(*by, "_r").agg(F.count("*").alias("_n"), F.sum(total or F.lit(0)).alias("_s"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sums.select(*by, "_r", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o) for c, o in (("_n", "_n0"), ("_s", "_s0"))])
    w = Window.partitionBy(*by, "_r").orderBy(*order)
    own = ranged.withColumn("rank", F.row_number().over(w))
    if total:
        own = own.withColumn("running", F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    offsets = offsets.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate([*by, "_r"])], "_n0", "_s0")
    same = reduce(and_, [own[c].eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate([*by, "_r"])])
    out = own.join(F.broadcast(offsets), same).withColumn("rank", F.col("rank") + F.col("_n0"))
    if total:
        out = out.withColumn("running", F.col("running") + F.col("_s0"))
    return out.drop("_r", "_n0", "_s0", *[f"_o{i}" for i in range(len(by) + 1)])
