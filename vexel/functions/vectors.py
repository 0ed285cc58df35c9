"""Vector arithmetic on array<double> columns, as column expressions.

Norms are columns of their own where they are used more than once: inside a lambda the optimizer would inline them and
evaluate them for every entry. `barrier` keeps a computed vector from being inlined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: str | Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: str | Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def cosine(a: str | Column, b: str | Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Null if either vector is zero."""
    return ratio(dot(a, b), (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def mean(v: str | Column) -> Column:
    return ratio(total(v), F.size(v).cast("double"))


def std_pop(v: str | Column) -> Column:
    """Population standard deviation of the entries."""
    m = mean(v)
    return F.sqrt(F.greatest(F.lit(0.0), ratio(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), F.size(v).cast("double")) - m * m))


def top_softmax(logits: str | Column) -> Column:
    """The largest of the softmax probabilities."""
    top = F.array_max(logits)
    return 1 / F.aggregate(F.transform(logits, lambda x: x), F.lit(0.0), lambda s, x: s + F.exp(x - top))


def normalised(df: DataFrame, v: str, out: str, eps: float | None = None) -> DataFrame:
    """Adds v / |v|, or v / (|v| + eps); without eps a zero vector gives null entries. The generator is a barrier
    that keeps the norm from being evaluated for each entry."""
    n = norm(v) + (F.lit(eps) if eps else F.lit(0.0))
    held = df.withColumn("_held", F.explode(F.array(F.struct(F.col(v).alias("v"), n.alias("n")))))
    return held.withColumn(out, F.transform("_held.v", lambda x: F.try_divide(x, F.col("_held.n")))).drop("_held")


def averaged(df: DataFrame, keys: list[str], v: str, weight: str | None = None, out: str = "embedding") -> DataFrame:
    """Per key the mean of the vectors, or their sum by weight: entries are summed map-side, and a group's D sums only
    are put together."""
    w = F.col(weight) if weight else F.lit(1.0)
    entries = df.select(*keys, w.alias("_w"), F.posexplode(v).alias("_k", "_x"))
    value = F.sum(F.col("_w") * F.col("_x")) if weight else F.avg("_x")
    sums = entries.groupBy(*keys, "_k").agg(value.alias("_x"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_x"))), lambda s: s["_x"]).alias(out))
