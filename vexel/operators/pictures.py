"""Pictures as rows (height, width, channels, data: bytes in order blue, green, red[, alpha]) and what is seen in them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import density_count, safe_ratio, sample_rate
from . import diverse

SIDE = 224  # of the picture that features are taken from


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """The picture as an array; none if the bytes aren't as many as its size says, or there are none."""
    if not data or min(height or 0, width or 0, channels or 0) < 1 or len(data) != height * width * channels:
        return None
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def on_white(picture: np.ndarray) -> np.ndarray:
    """Three channels: gray ones repeated, an alpha channel laid over white."""
    if picture.shape[2] == 1:
        return np.repeat(picture, 3, axis=2)
    if picture.shape[2] < 4:
        return picture[..., :3]
    alpha = picture[..., 3:4].astype(np.uint32)
    over = picture[..., :3] * alpha + 255 * (255 - alpha)
    return ((over + 127) // 255).astype(np.uint8)


def gray(bgr: np.ndarray) -> np.ndarray:
    """Brightness by the weights of ITU-R BT.601, in whole numbers."""
    # The weights of blue, green and red, in 1 / 2^14.
    b, g, r = (bgr[..., i].astype(np.int64) for i in range(3))
    return ((1868 * b + 9617 * g + 4899 * r + (1 << 13)) >> 14).astype(np.uint8)


def resized(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, from the centres of pixels, without smoothing before."""

    def places(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = places(picture.shape[0], height)
    x0, x1, fx = places(picture.shape[1], width)
    p = picture.astype(float)
    rows = p[y0] * (1 - fy)[:, None, None] + p[y1] * fy[:, None, None]
    return np.rint(rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]).astype(np.uint8)


def is_good(bgr: np.ndarray, min_std: float = 10.0, low: float = 5.0, high: float = 250.0) -> bool:
    g = gray(bgr)
    return bool(low <= g.mean() <= high and g.std() > min_std)


def average_hash(bgr: np.ndarray) -> str:
    g = gray(resized(bgr, 8, 8))
    return "".join("01"[int(x)] for x in (g > g.mean()).ravel())


def features(bgr: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Colours, edges and texture of the resized picture: 96 + 1 + (side / 16)^2 numbers."""
    small = resized(bgr, side, side)
    return diverse.picture_features(small, gray(small))


def composited(frames: DataFrame) -> DataFrame:
    """The pictures with three channels, alpha over white; null data where a picture's bytes don't fit its size."""

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            out = [None if (p := pixels(*row)) is None else on_white(p).tobytes() for row in zip(*(t.column(c).to_pylist() for c in ("height", "width", "channels", "data")))]
            t = t.set_column(t.schema.get_field_index("data"), "data", pa.array(out, pa.binary()))
            t = t.set_column(t.schema.get_field_index("channels"), "channels", pa.array([3] * t.num_rows, t.schema.field("channels").type))
            yield from t.to_batches()

    return frames.mapInArrow(run, frames.schema)


def described(frames: DataFrame, min_std: float = 10.0, side: int = SIDE) -> DataFrame:
    """(video_id, frame_idx, good, hash, features) of frames (video_id, frame_idx, height, width, channels, data). A frame
    that can't be read isn't good; hash and features are null where it isn't good. Pixels don't leave their task."""
    kinds = dict(frames.dtypes)

    def run(batches):
        for batch in batches:
            cols = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            good, hashes, found = [], [], []
            for row in zip(*(cols[c] for c in ("height", "width", "channels", "data"))):
                picture = pixels(*row)
                picture = None if picture is None else on_white(picture)
                good.append(picture is not None and is_good(picture, min_std))
                hashes.append(average_hash(picture) if good[-1] else None)
                found.append(features(picture, side) if good[-1] else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good), pa.array(hashes, pa.string()), pa.array(found, pa.list_(pa.float64()))], ["video_id", "frame_idx", "good", "hash", "features"])

    rows = frames.select("video_id", "frame_idx", "height", "width", "channels", "data")
    return rows.mapInArrow(run, f"video_id {kinds['video_id']}, frame_idx {kinds['frame_idx']}, good boolean, hash string, features array<double>")


def looked_at(videos: DataFrame, frames: DataFrame, fps: float = 1.0, rate: int = 10) -> DataFrame:
    """The frames, with their video's `k` and `fps`, that diverse selection looks at: every rate-th one, or more of them
    where too few would be left. Videos without frames, or without a duration, have none."""
    k = density_count(F.col("duration"), fps)
    step = sample_rate(F.col("frame_count"), F.col("duration"), k, F.lit(rate))
    v = videos.where("frame_count > 0").select("video_id", "fps", k.alias("k"), step.alias("_step")).where("k is not null and _step is not null")
    return frames.join(v, "video_id").where(F.col("frame_idx") % F.col("_step") == 0).drop("_step")


def diverse_selection(videos: DataFrame, frames: DataFrame, fps: float = 1.0, rate: int = 10, min_std: float = 10.0, side: int = SIDE) -> DataFrame:
    """(video_id, position, index, timestamp, hash): the visually diverse frames of each video, in order of time.

    Frames are looked at by looked_at(), unreadable, dark, bright and flat ones left out, the others described by colours,
    edges and texture; as many as the density asks for are chosen by k-means, or all, if there are no more. A task of the
    last step holds the features of one video.
    """
    some = looked_at(videos, frames, fps, rate)
    seen = described(some, min_std, side).where("good")
    rows = seen.join(videos.select("video_id", "fps", density_count(F.col("duration"), fps).alias("k")), "video_id")
    chosen = diverse.diverse_frames(rows, "k", "features")
    kept = rows.join(chosen, ["video_id", "frame_idx"], "left_semi")
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    return kept.select("video_id", (F.row_number().over(w) - 1).alias("position"), F.col("frame_idx").alias("index"), safe_ratio(F.col("frame_idx"), F.col("fps")).alias("timestamp"), "hash")


def extraction_results(videos: DataFrame, chosen: DataFrame, strategy: str = "diverse", fps: float = 1.0) -> DataFrame:
    """A row for each video of what was chosen: success (it can be probed), strategy, sampling_method, target and actual
    frames, extraction and configured density, frame_indices and metadata."""
    found = chosen.groupBy("video_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("position", "index", "timestamp", "hash"))).alias("m"))
    duration, known = F.col("duration"), F.col("frame_count").isNotNull() & F.col("duration").isNotNull()
    n = F.coalesce("n", F.lit(0))
    rows = videos.join(found, "video_id", "left")
    metadata = F.transform("m", lambda x: F.struct(x["index"].alias("index"), x["timestamp"].alias("timestamp"), x["hash"].alias("hash")))
    return rows.select(
        "video_id", known.alias("success"), F.lit(strategy).alias("strategy"), F.lit("density-based").alias("sampling_method"), duration.alias("video_duration"), density_count(duration, fps).alias("target_frames"), n.alias("actual_frames"),
        safe_ratio(n, duration).alias("extraction_density"), F.lit(fps).alias("configured_density"), F.transform("m", lambda x: x["index"]).alias("frame_indices"), metadata.alias("metadata"),
    )
