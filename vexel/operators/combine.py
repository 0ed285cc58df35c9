"""One vector a video from the vectors of its frames (video_id, frame_idx, embedding[, logits]).

Frames of a video are few, and pairs are made within a video only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.scalars import linspace

def _video():
    return Window.partitionBy("video_id")


def _counted(frames: DataFrame) -> DataFrame:
    return frames.withColumn("n", F.count("*").over(_video()))


def _softmax(x: Column) -> Column:
    e = F.exp(x - F.max(x).over(_video()))
    return e / F.sum(e).over(_video())


def _pairs(frames: DataFrame, on: Callable[[Column, Column], Column], index: str = "frame_idx") -> DataFrame:
    """(video_id, frame_idx, other, cosine) of frame pairs of a video."""
    held = frames.select("video_id", "frame_idx", F.col(index).alias("place"), "embedding", vectors.norm("embedding").alias("norm"))
    a, b = held.alias("a"), held.alias("b")
    joined = a.join(b, (F.col("a.video_id") == F.col("b.video_id")) & on(F.col("a.place"), F.col("b.place")))
    return joined.select("a.video_id", "a.frame_idx", F.col("b.frame_idx").alias("other"), vectors.cosine("a.embedding", "b.embedding", F.col("a.norm"), F.col("b.norm")).alias("cosine"))


def average(frames: DataFrame) -> DataFrame:
    return vectors.averaged(frames, ["video_id"], "embedding")


def diversity_weights(frames: DataFrame) -> DataFrame:
    """Softmax of half the population deviation of a frame's cosines to the others; uniform for one or two frames."""
    spread = _pairs(frames, lambda i, j: i != j).groupBy("video_id", "frame_idx").agg(F.stddev_pop("cosine").alias("u"))
    rows = _counted(frames).join(spread, ["video_id", "frame_idx"], "left")
    return rows.withColumn("weight", F.when(F.col("n") <= 2, 1 / F.col("n")).otherwise(_softmax(F.col("u") / 2)))


def frequency_weights(frames: DataFrame, like: float = 0.95) -> DataFrame:
    """In inverse proportion to one more than the frames (with itself) of a cosine above `like`."""
    counts = _pairs(frames, lambda i, j: F.lit(True)).groupBy("video_id", "frame_idx").agg((1 / (F.count_if(F.col("cosine") > like) + 1)).alias("w"))
    rows = _counted(frames).join(counts, ["video_id", "frame_idx"])
    return rows.withColumn("weight", F.when(F.col("n") <= 2, 1 / F.col("n")).otherwise(F.col("w") / F.sum("w").over(_video())))


def confidence_weights(frames: DataFrame, tau: float = 2.0) -> DataFrame:
    """Softmax of the frames' confidence over tau; a frame without logits counts 0.1."""
    rows = frames.withColumn("confidence", F.coalesce(vectors.top_softmax("logits"), F.lit(0.1)))
    return rows.withColumn("weight", _softmax(F.col("confidence") / tau))


def coherence_weights(frames: DataFrame, window: int = 3) -> DataFrame:
    """Softmax of twice a frame's mean cosine to its neighbours within window // 2 places of the video's frames in order;
    uniform up to `window` frames."""
    h = window // 2
    placed = frames.withColumn("_place", F.row_number().over(_video().orderBy("frame_idx")))
    near = _pairs(placed, lambda i, j: (F.abs(i - j) >= 1) & (F.abs(i - j) <= h), "_place").groupBy("video_id", "frame_idx").agg(F.avg("cosine").alias("c"))
    rows = _counted(frames).join(near, ["video_id", "frame_idx"], "left")
    return rows.withColumn("weight", F.when(F.col("n") <= window, 1 / F.col("n")).otherwise(_softmax(F.coalesce("c", F.lit(0.0)) * 2)))


def weighted(weights: DataFrame) -> DataFrame:
    return vectors.averaged(weights, ["video_id"], "embedding", "weight")


def max_confidence(frames: DataFrame) -> DataFrame:
    """The embedding of the first frame of the highest confidence; a frame without logits has 0."""
    confidence = F.coalesce(vectors.top_softmax("logits"), F.lit(0.0))
    return frames.groupBy("video_id").agg(F.max_by("embedding", F.struct(confidence.alias("c"), (-F.col("frame_idx")).alias("f"))).alias("embedding"))


def uniform_temporal(frames: DataFrame, k: int = 4) -> DataFrame:
    """The mean of k frames evenly over the video; of all where there are no more than k."""
    w = _video().orderBy("frame_idx")
    rows = _counted(frames).withColumn("i", F.row_number().over(w) - 1)
    return average(rows.where((F.col("n") <= k) | F.array_contains(linspace(F.col("n").cast("int"), F.lit(k)), F.col("i"))))


#: By name; more can be put in.
COMBINERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "average": average,
    "weighted_diversity": lambda f: weighted(diversity_weights(f)),
    "weighted_frequency": lambda f: weighted(frequency_weights(f)),
    "max_confidence": max_confidence,
    "weighted_confidence": lambda f: weighted(confidence_weights(f)),
    "temporal_coherence": lambda f: weighted(coherence_weights(f)),
    "uniform_temporal": uniform_temporal,
}


def combine(frames: DataFrame, method: str) -> DataFrame:
    """One vector a video; frames without an embedding take no part."""
    if method not in COMBINERS:
        raise ValueError(f"{method!r} is none of {sorted(COMBINERS)}")
    return COMBINERS[method](frames.where(F.col("embedding").isNotNull()))


def video_status(expected: DataFrame, frames: DataFrame) -> DataFrame:
    """Per expected video: frames found, frames with an embedding, status and the first three failed frames."""
    failed = F.col("embedding").isNull()
    found = frames.groupBy("video_id").agg(F.count("*").alias("n"), F.count("embedding").alias("ok"), F.slice(F.array_sort(F.collect_list(F.when(failed, F.col("frame_idx")))), 1, 3).alias("f"))
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce("ok", F.lit(0))
    status = F.when(n == 0, "no frames").when(ok == 0, "all frames failed").when(ok < n, "some frames failed").otherwise("ok")
    return expected.join(found, "video_id", "left").select("video_id", n.alias("n_frames"), ok.alias("n_embedded"), status.alias("status"), F.array_join(F.coalesce("f", F.array().cast("array<int>")), ",").alias("failed_frames"))
