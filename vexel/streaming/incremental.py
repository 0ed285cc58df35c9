"""Incremental runs: new videos come as a file stream, those with results are passed over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.frames import pending, static_frames
from ..storage import exists


def process_new(spark: SparkSession, source: str, results: str, checkpoint: str, schema: str, step: Callable[[DataFrame], DataFrame] = static_frames) -> StreamingQuery:
    """Starts a query over Parquet files of videos that come into `source`; it ends when all that is there is done.

    Each micro-batch runs `step` over videos without results yet and appends its rows with their sampling method. A
    batch that is repeated after a failure finds what it has written and adds nothing.
    """

    def batch(df: DataFrame, _: int) -> None:
        if exists(spark, results):
            done = spark.read.schema("video_id string, sampling_method string").parquet(results)
        else:  # the first batch finds no results yet
            done = spark.createDataFrame([], "video_id string, sampling_method string")
        new = step(pending(df.dropDuplicates(["video_id"]), done))
        new.selectExpr("*", "'density-based' as sampling_method").write.mode("append").parquet(results)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
