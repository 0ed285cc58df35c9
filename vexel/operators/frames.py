"""Choice and quality of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.scalars import average_hash, density_count, linspace, safe_ratio
from .selection import median


def good_quality(gray: Column, min_std: float = 10.0, low: float = 5.0, high: float = 250.0) -> Column:
    """Neither black, white nor flat; an absent or empty frame isn't good."""
    m = vectors.mean(gray)
    return F.coalesce((F.size(gray) > 0) & m.between(low, high) & (vectors.std_pop(gray) > min_std), F.lit(False))


def hashed(frames: DataFrame, gray: str = "g") -> DataFrame:
    return frames.withColumn("hash", average_hash(F.col(gray)))


def static_frames(videos: DataFrame, fps: float = 1.0) -> DataFrame:
    """(video_id, position, index, timestamp) of frames evenly over each video of (duration, fps, frame_count): the
    density decides their number; repeats stay. Position counts them from 0."""
    k = density_count(F.col("duration"), fps)
    v = videos.where("frame_count > 0").select("video_id", "fps", F.posexplode(linspace(F.col("frame_count").try_cast("int"), k)).alias("position", "index"))
    return v.select("video_id", "position", "index", safe_ratio(F.col("index"), F.col("fps")).alias("timestamp"))


def kept_frames(frames: DataFrame, quality: DataFrame, min_std: float = 10.0) -> DataFrame:
    """Chosen frames whose picture (video_id, index, g) is good, numbered anew."""
    w = Window.partitionBy("video_id").orderBy("position")
    good = frames.join(quality.where(good_quality(F.col("g"), min_std)).select("video_id", "index"), ["video_id", "index"], "left_semi")
    return good.withColumn("position", F.row_number().over(w) - 1)


def extraction_stats(results: DataFrame) -> DataFrame:
    """One row; the medians are exact and found first, by passes over the results."""
    d, n = F.col("duration"), F.col("frames")
    middle = {c: F.lit(median(results, c)).cast("double").alias(f"median_{c}") for c in ("duration", "frames")}
    return results.agg(F.count("*").alias("n"), F.avg(d).alias("mean_duration"), middle["duration"], F.min(d).alias("min_duration"), F.max(d).alias("max_duration"), F.avg(n).alias("mean_frames"), middle["frames"], F.avg(safe_ratio(n, d)).alias("mean_density"))


def pending(videos: DataFrame, done: DataFrame, method: str = "density-based") -> DataFrame:
    """Videos without a result of this sampling method."""
    return videos.join(done.where(F.col("sampling_method") == method).select("video_id"), "video_id", "left_anti")


def split(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in the list of a split."""
    return items.join(ids.select("video_id"), "video_id", "left_semi")


def z_scores(features: DataFrame, key: str, v: str = "v") -> DataFrame:
    """(key, k, z): each feature less its mean over its population deviation; 0 for a constant one."""
    e = features.select(key, F.posexplode(v).alias("k", "x"))
    s = e.groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return e.join(F.broadcast(s), "k").select(key, "k", F.coalesce(F.try_divide(F.col("x") - F.col("m"), F.col("s")), F.lit(0.0)).alias("z"))
