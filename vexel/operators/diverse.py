"""Operators that need numpy in a group: picture features, k-means choice of frames, inference, curve fits, PCA."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Rounds, stored


def colour_histogram(bgr: np.ndarray, bins: int = 32) -> np.ndarray:
    h = np.concatenate([np.histogram(bgr[..., c], bins, (0, 256))[0] for c in range(3)]).astype(float)
    return h / (h.sum() + 1e-6)


def edge_density(gray: np.ndarray, low: float = 50, high: float = 150) -> float:
    """Share of edge pixels by Canny (1986): gradient, thinning along its direction, hysteresis."""
    g = np.pad(gray.astype(float), 1, mode="edge")
    gx = g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:] - g[:-2, :-2] - 2 * g[1:-1, :-2] - g[2:, :-2]
    gy = g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:] - g[:-2, :-2] - 2 * g[:-2, 1:-1] - g[:-2, 2:]
    size = np.abs(gx) + np.abs(gy)
    m = np.pad(size, 1)
    turn = np.rint(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    near = {0: ((1, 2), (1, 0)), 1: ((2, 2), (0, 0)), 2: ((2, 1), (0, 1)), 3: ((2, 0), (0, 2))}
    top = np.zeros(size.shape, bool)
    for t, pair in near.items():
        a, b = (m[r : r + size.shape[0], c : c + size.shape[1]] for r, c in pair)
        top |= (turn == t) & (size > a) & (size >= b)
    edge, weak = top & (size > high), top & (size > low)
    while True:
        p = np.pad(edge, 1)
        grown = weak & np.any([p[r : r + size.shape[0], c : c + size.shape[1]] for r in range(3) for c in range(3)], axis=0)
        if (grown == edge).all():
            return float(edge.mean())
        edge = grown


def block_variance(gray: np.ndarray, block: int = 16) -> np.ndarray:
    h, w = (x // block for x in gray.shape)
    v = gray[: h * block, : w * block].reshape(h, block, w, block).astype(float).var(axis=(1, 3)).ravel()
    return v / (v.max(initial=0) + 1e-6)


def picture_features(bgr: np.ndarray, gray: np.ndarray | None = None) -> np.ndarray:
    """Colours, edges and texture, weighted 0.5, 0.3 and 0.2."""
    gray = bgr @ np.array([0.114, 0.587, 0.299]) if gray is None else gray
    return np.concatenate((0.5 * colour_histogram(bgr), [0.3 * edge_density(gray)], 0.2 * block_variance(gray)))


def kmeans(x: np.ndarray, k: int, restarts: int = 10, seed: int = 42, rounds: int = 100) -> np.ndarray:
    """Lloyd's centres of the best of several starts."""
    rng, best, least = np.random.default_rng(seed), x[:k], np.inf
    for _ in range(restarts):
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            own = d.argmin(1)
            new = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
        if cost < least:
            best, least = c, cost
    return best


def diverse_frames(frames: DataFrame, k: int | str = 4, v: str = "embedding") -> DataFrame:
    """(video_id, frame_idx) of k different frames of each video: k-means over z-scored features, of each cluster
    the frame nearest to its centre; all frames where there are no more than k. `k` is a number, or a column that is the
    same for all frames of a video. A group is one video."""
    many = F.lit(k) if isinstance(k, int) else F.col(k)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        k = int(pdf["_k"].iloc[0])
        if len(pdf) > k:
            x = np.array(pdf[v].tolist(), float)
            s = x.std(0)
            x = np.where(s > 0, (x - x.mean(0)) / np.where(s > 0, s, 1), 0.0)
            c = kmeans(x, k)
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            own = d.argmin(1)  # each centre's frame is one of its own cluster, so no frame is chosen twice
            pdf = pdf.iloc[sorted(int(np.where(own == i, d[:, i], np.inf).argmin()) for i in range(len(c)) if (own == i).any())]
        return pdf[["video_id", "frame_idx"]]

    kind = dict(frames.dtypes)
    return frames.select("video_id", "frame_idx", v, many.alias("_k")).groupBy("video_id").applyInPandas(choose, f"video_id {kind['video_id']}, frame_idx {kind['frame_idx']}")


def embedded(frames: DataFrame, embed: Callable[[list[bytes]], np.ndarray], batch: int = 16) -> DataFrame:
    """(video_id, frame_idx, embedding, error): a given model over frames (video_id, frame_idx, content) in batches. A
    batch that fails gives its frames a null embedding and the error's text."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                out, error = [None] * len(part), None
                try:
                    out = [list(map(float, v)) for v in embed(part["content"].tolist())]
                except Exception as e:  # noqa: BLE001  any failure of the model is the frames' result
                    error = str(e)
                yield pd.DataFrame({"video_id": part["video_id"].to_numpy(), "frame_idx": part["frame_idx"].to_numpy(), "embedding": out, "error": error})

    kind = dict(frames.dtypes)
    return frames.select("video_id", "frame_idx", "content").mapInPandas(run, f"video_id {kind['video_id']}, frame_idx {kind['frame_idx']}, embedding array<double>, error string")


def _sums(points: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Per key the sums of a Gauss-Newton step at the parameters (a, b) of `state`, and the squared error there."""
    x, y, a = F.col("x"), F.col("y"), F.col("a")
    e = F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), -F.col("b") * x)))
    rows = points.join(state, key).select(key, (y - a * e).alias("r"), e.alias("u"), (-a * x * e).alias("v"))
    sums = {"uu": "u * u", "uv": "u * v", "vv": "v * v", "ur": "u * r", "vr": "v * r", "cost": "r * r"}
    return rows.groupBy(key).agg(*[F.sum(F.expr(e)).alias(c) for c, e in sums.items()])


def exponential_fit(points: DataFrame, key: str, rounds: int = 60, close: float = 1e-10) -> DataFrame:
    """(key, a, b) of y = a exp(-b x) of least squares for the points (x, y) of each key.

    Damped Gauss-Newton steps, from the line through (x, ln y) of the positive points: each round is one sum over the
    points, which Spark adds up in part where they are, so a key may have any number of them. Rounds end when no key's
    squared error falls by more than a share of `close`. Points with a null take no part; a key whose points are
    fewer than two, or none of them positive, has nulls.
    """
    points = stored(points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null"))
    w, ly = F.col("y") * F.col("y"), F.ln("y")
    line = points.where("y > 0").groupBy(key).agg(F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("x") * F.col("x")).alias("wxx"), F.sum(w * ly).alias("wl"), F.sum(w * F.col("x") * ly).alias("wxl"))
    slope = F.coalesce(F.try_divide(F.expr("w * wxl - wx * wl"), F.expr("w * wxx - wx * wx")), F.lit(0.0))
    keep = Rounds(points.sparkSession)
    first = line.select(key, F.exp((F.col("wl") - slope * F.col("wx")) / F.col("w")).alias("a"), (-slope).alias("b"))
    now = keep.keep(first.join(_sums(points, first, key), key).withColumn("damp", F.lit(1e-3)).withColumn("still", F.lit(True)))
    for _ in range(rounds):
        step = now.where("still").withColumn("du", F.col("uu") * (1 + F.col("damp"))).withColumn("dv", F.col("vv") * (1 + F.col("damp"))).withColumn("det", F.expr("du * dv - uv * uv"))
        tried = step.select(key, (F.col("a") + F.coalesce(F.try_divide(F.expr("ur * dv - vr * uv"), F.col("det")), F.lit(0.0))).alias("a"), (F.col("b") + F.coalesce(F.try_divide(F.expr("vr * du - ur * uv"), F.col("det")), F.lit(0.0))).alias("b"))
        new = tried.join(_sums(points, tried, key), key).select(key, *[F.col(c).alias(f"_{c}") for c in ("a", "b", "uu", "uv", "vv", "ur", "vr", "cost")])
        better = F.coalesce(F.col("_cost") <= F.col("cost"), F.lit(False))
        both = now.join(new, key, "left")
        still = F.col("_cost").isNotNull() & F.when(better, F.col("cost") - F.col("_cost") > close * F.col("cost")).otherwise(F.col("damp") < 1e9)
        keep.next()
        now = keep.keep(both.select(key, *[F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("a", "b", "uu", "uv", "vv", "ur", "vr", "cost")], F.when(better, F.col("damp") / 10).otherwise(F.col("damp") * 10).alias("damp"), still.alias("still")))
        if now.where("still").isEmpty():
            break
    few = points.groupBy(key).agg(F.count_distinct("x").alias("n"))
    known = F.col("n") > 1
    return few.join(now, key, "left").select(key, F.when(known, F.col("a")).alias("a"), F.when(known, F.col("b")).alias("b"))


def projected(vectors: DataFrame, v: str = "v", dims: int = 2) -> DataFrame:
    """(node_id, x, y) by principal components, a linear stand-in for neighbour embeddings that need other libraries."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("node_id", array_to_vector(v).alias("features"))
    out = PCA(k=dims, inputCol="features", outputCol="p").fit(rows).transform(rows)
    p = vector_to_array("p")
    return out.select("node_id", p[0].alias("x"), p[1].alias("y"))


def projected_centroids(points: DataFrame, labels: DataFrame) -> DataFrame:
    return points.join(labels, "node_id").groupBy("cluster_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
