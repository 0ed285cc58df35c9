"""Readers of tables, id lists and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """video_id of each line's first tab field; blank lines and those that start with # are left out."""
    return ids_of_lines(spark.read.text(path))


def ids_of_lines(lines: DataFrame) -> DataFrame:
    kept = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    return kept.select(F.trim(F.split("value", "\t")[0]).alias("video_id"))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file, over any number of lines."""
    return spark.read.schema(schema).json(path, multiLine=True)


def duration_cache(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, seconds) from a JSON object; null for unreadable videos."""
    return durations_of_text(spark.read.text(path, wholetext=True))


def durations_of_text(whole: DataFrame) -> DataFrame:
    return whole.select(F.explode(F.from_json("value", "map<string,double>")).alias("video_id", "seconds"))


def frame_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Image files below one folder a video: video_id, file, frame_idx in file-name order; bytes if asked for."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    out = files.where(F.lower("path").rlike(r"\.(jpg|jpeg|png)$")).select(F.replace(F.element_at(parts, -2), F.lit("_frames"), F.lit("")).alias("video_id"), F.element_at(parts, -1).alias("file"), *(["content"] if content else []))
    return out.withColumn("frame_idx", F.row_number().over(Window.partitionBy("video_id").orderBy("file")) - 1)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: origin, height, width, nChannels, mode and BGR data, by Spark's image source."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of several paths that is there, by Hadoop's file systems."""
    return next((p for p in paths if exists(spark, p)), None)


def name_parts(file: Column) -> dict[str, Column]:
    """selection, model and method of a result file's name, empty where it isn't one; the method may hold underscores."""
    pattern = r"^(?:climate_3k_)?(.+?)_1fps_(dinov2(?:_vitb14_lc)?|convnextv2)_([a-z_]+?)(?:_labels|_clusters)?\.[a-z0-9]+$"
    return {c: F.regexp_extract(file, pattern, i + 1) for i, c in enumerate(("selection", "model", "method"))}


def result_files(spark: SparkSession, glob: str) -> DataFrame:
    """Names of result files taken apart: file, selection, model, method."""
    files = spark.read.format("binaryFile").load(glob).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return files.withColumns(name_parts(F.col("file")))
