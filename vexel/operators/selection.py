"""Exact medians without a task that sees all values.

Each pass brackets the middle by a sketch of bounded size, counts what lies below, at and within the bracket, and goes on
within it; a pass leaves about a hundredth of the values. What the bracket's ends hold, often ties, is settled by counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 2000  # of the sketch: ranks are off by a share of 1 / ACCURACY at most
FEW = 4096  # values that are settled on the driver


def at_ranks(df: DataFrame, value: str, ranks: list[int], few: int = FEW) -> dict[int, float]:
    """The values at some neighbouring ranks, from 0, in ascending order of a double column without nulls and NaN. Ranks
    beyond the last row are left out."""
    rows = df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    x = F.col("x")
    found: dict[int, float] = {}
    below, inside = 0, rows.count()
    todo = sorted(r for r in ranks if 0 <= r < inside)
    while todo:
        if inside <= few:
            at = below
            for r in sorted(rows.groupBy("x").agg(F.count("*").alias("c")).collect(), key=lambda r: r.x):
                found |= {k: r.x for k in todo if at <= k < at + r.c}
                at += r.c
            return found
        low = max(0.0, (todo[0] - below) / inside - 2 / ACCURACY)
        high = min(1.0, (todo[-1] + 1 - below) / inside + 2 / ACCURACY)
        a, b = rows.agg(F.percentile_approx("x", [low, high], ACCURACY)).first()[0]
        less, first, within, last = rows.agg(F.count_if(x < a), F.count_if(x == a), F.count_if((x > a) & (x < b)), F.count_if(x == b)).first()
        if below + less > todo[0] or below + less + first + within + (last if b > a else 0) <= todo[-1]:
            raise ArithmeticError("the sketch's bracket misses the middle")
        found |= {k: a for k in todo if k < below + less + first}
        found |= {k: b for k in todo if k >= below + less + first + within}
        todo = [k for k in todo if k not in found]
        rows, below, inside = rows.where((x > F.lit(a)) & (x < F.lit(b))), below + less + first, within
    return found


def median(df: DataFrame, value: str, few: int = FEW) -> float | None:
    """The middle value, or the mean of the two middle ones; none without values."""
    n = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).count()
    if not n:
        return None
    at = at_ranks(df, value, [(n - 1) // 2, n // 2], few)
    return (at[(n - 1) // 2] + at[n // 2]) / 2
