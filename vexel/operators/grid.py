"""The grid of configurations: frame selections, models and methods, from frames to scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import config_name
from ..storage import stored
from . import combine, quality

# The frame selections, and the methods of each model.
SELECTIONS = ["static", "diverse"]
METHODS = {"convnextv2": ["average", "weighted_diversity", "max_confidence", "weighted_confidence"], "dinov2": ["average", "weighted_diversity", "temporal_coherence"]}
# Suffixes of model names in file names, which other names leave out.
LONG_NAMES = {"1fps_dinov2_vitb14_lc": "dinov2", "1fps_convnextv2": "convnextv2"}
# What the selections do.
DESCRIPTIONS = {"static": "Uniformly spaced frames at %s fps density", "diverse": "Visually diverse frames selected at %s fps density"}


def short_name(config: Column) -> Column:
    """A configuration's name with the short model name, as some result files have it."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), LONG_NAMES.items(), config)


def strategy_text(selection: Column, fps: Column) -> Column:
    """What a frame selection does, for its information file; another one is unknown."""
    known = [F.when(selection == name, F.format_string(text, fps.cast("string"))) for name, text in DESCRIPTIONS.items()]
    return F.coalesce(*known, F.lit("Unknown strategy"))


def video_vectors(frames: DataFrame, methods: dict[str, list[str]] = METHODS) -> DataFrame:
    """(selection, model, method, config, node_id, v) from frames (selection, model, video_id, frame_idx, embedding,
    logits): a vector for each video of each configuration. A model's frames of all selections are combined at once;
    frames of other models, and those without an embedding, take no part."""
    found = []
    for model, names in methods.items():
        own = frames.where(F.col("model") == model).select(F.struct("selection", "video_id").alias("video_id"), "frame_idx", "embedding", "logits")
        for method in names:
            rows = combine.combine(own, method)
            found.append(rows.select("video_id.selection", F.lit(model).alias("model"), F.lit(method).alias("method"), F.col("video_id.video_id").alias("node_id"), F.col("embedding").alias("v")))
    rows = reduce(DataFrame.unionByName, found)
    # Stored, as each metric reads them.
    return stored(rows.withColumn("config", config_name(F.col("selection"), F.col("model"), F.col("method"))))


def configurations(vectors: DataFrame) -> DataFrame:
    """(selection, model, method, config, short_name, n_videos) of the configurations that have vectors."""
    rows = vectors.groupBy("selection", "model", "method", "config").agg(F.count("*").alias("n_videos"))
    return rows.withColumn("short_name", short_name(F.col("config")))


def scores(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """A row for each configuration of labels (config, node_id, cluster_id) with its selection, model, method, metrics
    and overall score, from the vectors of the same configuration."""
    names = vectors.select("config", "selection", "model", "method").distinct()
    return names.join(quality.scored(quality.metrics(labels, vectors.select("config", "node_id", "v"))), "config")
