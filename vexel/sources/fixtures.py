"""Views of the test tables that stand for the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from .tables import table


def video_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), vectors.doubles("embedding").alias("v"))


def labels_a(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("label").cast("int").alias("cluster_id"))


def labels_b(spark: SparkSession, sf: str) -> DataFrame:
    bit = lambda i, w: (F.col("embedding")[i] > 0).cast("int") * w
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), (bit(0, 4) + bit(1, 2) + bit(2, 1)).alias("cluster_id"))


def two_configs(spark: SparkSession, sf: str) -> DataFrame:
    a, b = labels_a(spark, sf), labels_b(spark, sf)
    return a.withColumn("config", F.lit("a")).unionByName(b.withColumn("config", F.lit("b")))


def frame_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Ten frames a video, but 1, 2 and 3 for the first three."""
    gone = F.col("vec_id").between(1, 9) | F.col("vec_id").between(12, 19) | F.col("vec_id").between(23, 29)
    v = vectors.doubles("embedding")
    return table(spark, sf, "embeddings").where(~gone).select(F.floor(F.col("vec_id") / 10).cast("long").alias("video_id"), (F.col("vec_id") % 10).cast("int").alias("frame_idx"), v.alias("embedding"), v.alias("logits"))


def grid_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of two selections, all and those of even place, by two models, the second with the entries turned round."""
    f = frame_embeddings(spark, sf)
    both = f.withColumn("selection", F.lit("static")).unionByName(f.where("frame_idx % 2 = 0").withColumn("selection", F.lit("diverse")))
    other = both.withColumn("embedding", F.reverse("embedding"))
    return both.withColumn("model", F.lit("convnextv2")).unionByName(other.withColumn("model", F.lit("dinov2")))


def grid_labels(vectors: DataFrame) -> DataFrame:
    """(config, node_id, cluster_id): a solver's labels are stood for by the signs of the first three entries."""
    bit = lambda i, w: (F.col("v")[i] > 0).cast("int") * w
    return vectors.select("config", "node_id", (bit(0, 4) + bit(1, 2) + bit(2, 1)).alias("cluster_id"))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    duration = F.col("o_totalprice") / 10000
    return o.select(
        F.concat(F.lit("id_"), "o_orderkey", F.lit("_"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("video_id"), duration.alias("duration"), (F.col("o_orderpriority") == "1-URGENT").alias("duplicate"),
        (F.col("o_orderstatus") == "F").alias("done"), F.lit(25.0).alias("fps"), F.floor(duration * 25).cast("long").alias("frame_count"),
    )


def thumbnails(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 gray values."""
    return video_embeddings(spark, sf).select("node_id", F.transform("v", lambda x: F.floor(F.least(F.greatest((x + 1) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("double")).alias("g"))


def pictures(spark: SparkSession, sf: str, side: int = 32) -> DataFrame:
    """(video_id, frame_idx, height, width, channels, data): a vector's 64 entries as 8 x 8 blue, green and red tiles,
    each tile of side / 8 pixels; a few pictures are flat, cut off or empty."""
    tile = side // 8
    f = frame_embeddings(spark, sf)
    level = lambda x, shift: F.lpad(F.hex(F.floor(F.least(F.greatest((x * 3 + 1) * 127.5 + shift, F.lit(0.0)), F.lit(255.0))).cast("long")), 2, "0")
    pixel = F.transform("embedding", lambda x: F.concat(level(x, 0), level(x, 20), level(-x, 0)))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.repeat(F.array_join(F.transform(F.slice(pixel, r * 8 + 1, 8), lambda p: F.repeat(p, tile)), ""), tile))
    data = F.unhex(F.array_join(rows, ""))
    number = F.xxhash64("video_id", "frame_idx") % 11
    data = F.when(number == 0, F.unhex(F.repeat(F.lit("808080"), side * side))).when(number == 1, F.substring(data, 1, 100)).when(number == 2, F.lit(None)).otherwise(data)
    return f.select("video_id", "frame_idx", F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(3).alias("channels"), data.alias("data"))


def picture_videos(spark: SparkSession, sf: str) -> DataFrame:
    """(video_id, fps, frame_count, duration): 5 frames a second, 5 seconds more for every third video."""
    v = frame_embeddings(spark, sf).groupBy("video_id").agg(F.count("*").alias("frame_count"))
    return v.select("video_id", F.lit(5.0).alias("fps"), "frame_count", (F.col("frame_count") / 5.0 + F.when(F.col("video_id") % 3 == 0, 5.0).otherwise(0.0)).alias("duration"))


def inline_videos(spark: SparkSession, sf: str) -> DataFrame:
    """(video_id, content): for each video of the registry the boxes of an MP4 file with its frames at 25 a second and no
    pictures; those of every seventh order are cut off, of every eleventh have no video track."""
    r = registry(spark, sf).withColumn("i", F.split("video_id", "_")[1].cast("long"))
    word = lambda c: F.lpad(F.hex(c.cast("long") if not isinstance(c, int) else F.lit(c)), 8, "0")
    text = lambda s: F.lit(s.encode().hex().upper())
    box = lambda kind, *parts: (lambda body: F.concat(word((F.length(body) / 2 + 8).cast("long")), text(kind), body))(F.concat(*parts))
    n = F.col("frame_count")
    kind = F.when(F.col("i") % 11 == 0, text("soun")).otherwise(text("vide"))
    hdlr = box("hdlr", word(0), word(0), kind, *[word(0)] * 3, F.lit("00"))
    mdhd = box("mdhd", *[word(0)] * 3, word(12800), word(n * 512), word(0))
    stbl = box("stbl", box("stts", word(0), word(1), word(n), word(512)), box("stsz", word(0), word(100), word(n)))
    moov = box("moov", box("mvhd", *[word(0)] * 3), box("trak", box("tkhd", word(0)), box("mdia", mdhd, hdlr, box("minf", stbl))))
    whole = F.unhex(F.concat(box("ftyp", text("isom"), word(512)), moov))
    return r.select("video_id", F.when(F.col("i") % 7 == 0, F.substring(whole, 1, 100)).otherwise(whole).alias("content"))
