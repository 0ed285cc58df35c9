"""Corpus sampling: registry, periods, allocation over them, choice within them, and statistics.

Random choices go by md5 of the id and the seed, so they are the same on every run and in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import expected_frames, id_date, period
from ..storage import stored
from .ranking import numbered
from .selection import ACCURACY, median

MIN_DURATION = 5.0


def shuffled(key: str | Column, seed: int = 42) -> Column:
    return F.md5(F.concat((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(f"_{seed}")).cast("binary"))


def unique_ids(corpus: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Distinct ids that aren't in `duplicates`."""
    return corpus.select("video_id").join(duplicates.select("video_id"), "video_id", "left_anti").distinct()


def registry_counts(corpus: DataFrame, duplicates: DataFrame) -> DataFrame:
    flagged = corpus.select("video_id").distinct().join(duplicates.select("video_id").distinct().withColumn("d", F.lit(1)), "video_id", "left")
    return flagged.agg(F.count("*").alias("total"), F.count("d").alias("duplicates"), F.count_if(F.col("d").isNull()).alias("unique_ids"))


def parsed(ids: DataFrame) -> DataFrame:
    """video_id with date, year, month and day; nulls where the id has no date."""
    d = id_date(F.col("video_id"))
    return ids.withColumn("date", d).withColumns({"year": F.year("date"), "month": F.month("date"), "day": F.dayofmonth("date")})


def classified(videos: DataFrame, least: float = MIN_DURATION) -> DataFrame:
    """Adds status: not found (no duration), filtered (too short) or valid."""
    d = F.col("duration")
    return videos.withColumn("status", F.when(d.isNull(), "not found").when(d < least, "filtered").otherwise("valid"))


def long_enough(videos: DataFrame, least: float = MIN_DURATION) -> DataFrame:
    return videos.where(F.col("duration") >= least)


def period_counts(videos: DataFrame) -> DataFrame:
    return videos.withColumn("period", period(id_date(F.col("video_id")))).where("period is not null").groupBy("period").agg(F.count("*").alias("n"))


def period_validity(videos: DataFrame, least: float = MIN_DURATION) -> DataFrame:
    v = classified(videos, least).withColumn("period", period(id_date(F.col("video_id")))).where("period is not null")
    ok = F.count_if(F.col("status") == "valid")
    return v.groupBy("period").agg(F.count("*").alias("total"), ok.alias("valid"), (ok / F.count("*") * 100).alias("pct_valid"))


def success_counts(videos: DataFrame, least: float = MIN_DURATION) -> DataFrame:
    n = F.count("*")
    c = classified(videos, least).groupBy("status").agg(n.alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("all")))).select("status", "n", (F.col("n") / F.col("all") * 100).alias("pct"))


def allocation(periods: DataFrame, target: int) -> DataFrame:
    """(period, n, alloc): a minimum for each period, the rest in proportion. Periods of n = 0 count as periods.

    One row a period; the totals are one broadcast row. The periods are stored, as they are gone over for each total.
    """
    periods = stored(periods)
    totals = periods.agg(F.sum("n").alias("all_n"), F.count("*").alias("P")).withColumn("T", F.least(F.lit(target).cast("long"), "all_n"))
    totals = totals.withColumn("m", F.greatest(F.lit(5), F.floor(F.col("T") / (2 * F.col("P"))))).where("P > 0")
    j = periods.join(F.broadcast(totals))
    first = j.agg(F.sum(F.least("m", "n")).alias("s1"))
    m = F.when(F.col("s1") > F.col("T"), F.greatest(F.lit(1), F.floor(F.col("T") / F.col("P")))).otherwise(F.col("m"))
    j = j.join(F.broadcast(first)).withColumn("m", m)
    rest = j.agg(F.sum(F.least("m", "n")).alias("s2"))
    j = j.join(F.broadcast(rest)).withColumn("R", F.col("T") - F.col("s2"))
    more = F.floor(F.col("R") * (F.col("n") / F.greatest("all_n", F.lit(1))))
    base = F.least("m", "n")
    return j.select("period", "n", F.when((F.col("R") > 0) & (F.col("n") > F.col("m")), F.least(base + more, "n")).otherwise(base).cast("long").alias("alloc"))


def _eighties(v: DataFrame) -> DataFrame:
    """(period, _d, _i): _down and id of the row at place floor(0.8 n) of its period (period, n, _down, video_id) in their
    order; no row where that is 0. A sketch brackets the place, rows before the bracket are counted, and only those within,
    some thousandths, are ranked; all rows of a period whose bracket misses the place are."""
    share = lambda x: F.percentile_approx(F.nanvl("_down", F.lit(float("inf"))), F.lit(x), ACCURACY)
    ends = v.groupBy("period").agg(F.floor(F.first("n") * 0.8).alias("_cut"), share(0.8 - 2 / ACCURACY).alias("_a"), share(0.8 + 2 / ACCURACY).alias("_b"))
    # Stored, as a sketch depends on the order of rows. NaN comes after infinity.
    ends = stored(ends.withColumn("_b", F.when(F.col("_b") == float("inf"), F.lit(float("nan"))).otherwise(F.col("_b"))))
    inside = F.col("_down").between(F.col("_a"), F.col("_b"))
    counts = v.join(F.broadcast(ends), "period").groupBy("period", "_cut", "_a", "_b").agg(F.count_if(F.col("_down") < F.col("_a")).alias("_before"), F.count_if(inside).alias("_within"))
    hit = (F.col("_cut") > F.col("_before")) & (F.col("_cut") <= F.col("_before") + F.col("_within"))
    counts = stored(counts.select("period", "_cut", F.when(hit, F.col("_a")).alias("_a"), "_b", F.when(hit, F.col("_before")).otherwise(0).alias("_before")))
    few = stored(v.select("period", "_down", "video_id").join(F.broadcast(counts), "period").where(F.col("_a").isNull() | inside))
    return numbered(few, ["_down", "video_id"], ["period"]).where(F.col("_before") + F.col("rank") == F.col("_cut")).select("period", F.col("_down").alias("_d"), F.col("video_id").alias("_i"))


def _foremost(v: DataFrame) -> DataFrame:
    """Of (period, alloc, _late, _hash, ...) all rows that may be among the first `alloc` of their period by (_late, _hash):
    rows are counted by the hash's first digits, and those whose digits begin after `alloc` rows are left out."""
    v = v.withColumn("_k", F.col("_late").cast("int") * 4096 + F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"))
    w = Window.partitionBy("period").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # 8192 rows a period at most
    counts = v.groupBy("period", "alloc", "_k").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    last = counts.where(F.col("_before") < F.col("alloc")).groupBy("period").agg(F.max("_k").alias("_last"))
    return v.join(F.broadcast(last), "period").where(F.col("_k") <= F.col("_last")).drop("_k", "_last")


def picked(videos: DataFrame, alloc: DataFrame, seed: int = 42) -> DataFrame:
    """(video_id, period, duration): from each period's longest 80 % (floor) `alloc` by md5; where these are too few,
    all of them and then the others by md5. Ids of equal duration go in order. The rows are stored and gone over some times, but only
    those around the 80 % and those that may be picked are ranked, within ranges of each period, so a period that holds most
    rows is no single task's."""
    alloc = stored(alloc)
    v = stored(videos.select("video_id", period(id_date(F.col("video_id"))).alias("period"), "duration")).join(F.broadcast(alloc), "period")
    v = v.select("video_id", "period", "duration", "n", "alloc", F.coalesce(-F.col("duration"), F.lit(float("inf"))).alias("_down"))
    v = v.join(F.broadcast(stored(_eighties(v))), "period", "left")
    after = F.col("_d").isNull() | (F.col("_down") > F.col("_d")) | ((F.col("_down") == F.col("_d")) & (F.col("video_id") > F.col("_i")))
    late = (F.col("n") > F.col("alloc")) & after
    v = v.select("video_id", "period", "duration", "alloc", late.alias("_late"), shuffled("video_id", seed).alias("_hash"))
    return numbered(stored(_foremost(v)), ["_late", "_hash", "video_id"], ["period"]).where(F.col("rank") <= F.col("alloc")).select("video_id", "period", "duration")


def trimmed(sample: DataFrame, target: int, least: int) -> DataFrame:
    """Takes what exceeds `target` from the largest periods first, their shortest videos, never below `least`. The sample is
    stored, so that it is drawn once."""
    sample = stored(sample)
    sizes = sample.groupBy("period").agg(F.count("*").alias("n"))
    over = sizes.agg(F.greatest(F.sum("n") - target, F.lit(0)).alias("excess"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "period").rowsBetween(Window.unboundedPreceding, -1)  # one row a period
    can = F.greatest(F.col("n") - least, F.lit(0))
    cut = sizes.withColumn("can", can).withColumn("before", F.coalesce(F.sum("can").over(w), F.lit(0))).join(F.broadcast(over))
    cut = cut.select("period", F.greatest(F.lit(0), F.least("can", F.col("excess") - F.col("before"))).alias("cut"))
    return numbered(sample.join(F.broadcast(cut), "period"), ["duration", "video_id"], ["period"]).where(F.col("rank") > F.col("cut")).drop("rank", "cut")


def with_durations(ids: DataFrame, cache: DataFrame, default: float = MIN_DURATION) -> DataFrame:
    return ids.join(cache, "video_id", "left").withColumn("duration", F.coalesce("seconds", F.lit(default))).drop("seconds")


def sample_table(sample: DataFrame) -> DataFrame:
    """The rows of the sample list; parts of the date are 'unknown' where the id has none."""
    p = parsed(sample)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in ("year", "month", "day", "date")]
    return p.select("video_id", *named, F.col("duration").alias("duration_seconds"), expected_frames(F.col("duration")).alias("expected_frames"))


def duration_stats(sample: DataFrame) -> DataFrame:
    """One row; the median is exact and found first, by passes over the sample."""
    d = F.col("duration")
    return sample.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.lit(median(sample, "duration")).cast("double").alias("median"), F.stddev_pop(d).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"), (F.sum(d) / 3600).alias("hours"), F.sum(F.floor(d)).alias("expected_frames"))


def duration_buckets(sample: DataFrame) -> DataFrame:
    d = F.col("duration")
    return sample.agg(F.count_if((d >= 5) & (d < 10)).alias("d5_10"), F.count_if((d >= 10) & (d < 30)).alias("d10_30"), F.count_if((d >= 30) & (d < 60)).alias("d30_60"), F.count_if(d >= 60).alias("d60"))


def period_stats(sample: DataFrame) -> DataFrame:
    """Per period: count, mean, hours, and the first three ids. The ids are ranked first: no list grows with a period."""
    v = sample.withColumn("period", period(id_date(F.col("video_id")))).where("period is not null")
    few = numbered(v.select("period", "video_id"), ["video_id"], ["period"]).where("rank <= 3").groupBy("period").agg(F.array_join(F.array_sort(F.collect_list("video_id")), ",").alias("ids"))
    s = v.groupBy("period").agg(F.count("*").alias("n"), F.avg("duration").alias("mean_duration"), (F.sum("duration") / 3600).alias("hours"))
    return s.join(few, "period").select("period", "n", "mean_duration", "hours", F.concat("ids", F.when(F.col("n") > 3, "...").otherwise("")).alias("sample_ids"))


def period_balance(sample: DataFrame) -> DataFrame:
    return period_counts(sample).agg(F.count("*").alias("n_periods"), F.avg("n").alias("mean_per_period"), F.stddev_pop("n").alias("std_per_period"))


def capped(labels: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """All nodes if there are no more than `cap`; else from each of k clusters max(1, cap // k) by md5, then `cap` of these
    by md5."""
    quota = F.when(F.count("*") <= cap, F.count("*")).otherwise(F.greatest(F.lit(1), F.floor(F.lit(cap) / F.greatest(F.count_distinct("cluster_id"), F.lit(1)))))
    k = labels.agg(quota.alias("quota"))
    some = numbered(labels.select("node_id", "cluster_id", shuffled("node_id", seed).alias("_hash")), ["_hash", "node_id"], ["cluster_id"])
    some = some.join(F.broadcast(k)).where(F.col("rank") <= F.col("quota")).drop("rank", "quota")
    return numbered(some, ["_hash", "node_id"]).where(F.col("rank") <= cap).select("node_id", "cluster_id")


def cluster_samples(labels: DataFrame, per_cluster: int = 10, largest: int = 10, seed: int = 42) -> DataFrame:
    """`per_cluster` members by md5 of each of the largest clusters."""
    from .clusters import top

    few = labels.join(F.broadcast(top(labels, largest).select("cluster_id")), "cluster_id", "left_semi")
    few = few.select("cluster_id", "node_id", shuffled("node_id", seed).alias("_hash"))
    return numbered(few, ["_hash", "node_id"], ["cluster_id"]).where(F.col("rank") <= per_cluster).select("cluster_id", "node_id")


def common_ids(a: DataFrame, b: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows of a whose key b has, or, where none is shared but the counts agree, rows matched by their order."""
    shared = a.join(b.select(key).distinct(), key, "left_semi")
    if not shared.isEmpty() or a.count() != b.count():
        return shared
    from .graph import node_ids

    return node_ids(a, key).join(node_ids(b, key).withColumnRenamed(key, f"other_{key}"), "node_id").join(a, key)
