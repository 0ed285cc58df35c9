"""Pictures, frame selection over them, and facts about video files."""

import struct

import numpy as np
import pytest

from vexel.operators import diverse, pictures, sampling
from vexel.sources import video

FRAME = "video_id long, frame_idx int, height int, width int, channels int, data binary"


def test_alpha_goes_over_white(spark):
    rows = [(1, 0, 1, 3, 4, bytes([10, 20, 30, 255, 10, 20, 30, 0, 0, 0, 0, 128])), (1, 1, 1, 2, 1, bytes([7, 9])), (1, 2, 1, 1, 3, b"abc"), (1, 3, 2, 2, 3, b"short"), (1, 4, 1, 1, 3, None)]
    out = {r.frame_idx: (r.channels, r.data and list(r.data)) for r in pictures.composited(spark.createDataFrame(rows, FRAME)).collect()}
    assert out[0] == (3, [10, 20, 30, 255, 255, 255, 127, 127, 127]) and out[1] == (3, [7, 7, 7, 9, 9, 9])
    assert out[2] == (3, list(b"abc")) and out[3] == (3, None) and out[4] == (3, None)


def test_resizing():
    p = np.array([[0, 100], [200, 40]], np.uint8)[..., None]
    assert pictures.resized(p, 2, 2).tolist() == p.tolist()
    assert pictures.resized(p, 1, 1).item() == 85
    assert pictures.resized(p, 4, 4)[0, :, 0].tolist() == [0, 25, 75, 100] and pictures.resized(p, 4, 4)[:, 0, 0].tolist() == [0, 50, 150, 200]
    assert pictures.resized(np.full((5, 7, 3), 9, np.uint8), 224, 224).tolist() == np.full((224, 224, 3), 9).tolist()
    x = np.arange(6, dtype=np.uint8).reshape(1, 6, 1) * 40
    assert pictures.resized(x, 1, 3)[0, :, 0].tolist() == [20, 100, 180]


def test_features_of_pictures():
    half = np.zeros((64, 64, 3), np.uint8)
    half[:, 32:] = 255
    f = pictures.features(half)
    assert len(f) == 96 + 1 + 196
    assert f[:96].sum() == pytest.approx(0.5, abs=1e-6) and f[0] == pytest.approx(f[31]) and f[0] == pytest.approx(1 / 12, abs=0.01)
    assert 0 < f[96] < 0.3 * 4 / 224 and f[97:].max() == pytest.approx(0.2, abs=1e-6)
    assert pictures.average_hash(half) == "00001111" * 8
    assert not pictures.is_good(np.zeros((8, 8, 3), np.uint8)) and not pictures.is_good(np.full((8, 8, 3), 128, np.uint8)) and pictures.is_good(half)
    assert pictures.gray(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]], np.uint8)).tolist() == [[29, 150, 76, 255]]


def plain_selection(video_frames, duration, fps, rate):
    """The selection of one video by numpy alone."""
    k = int(max(4, min(60, np.floor(duration))))
    n = len(video_frames)
    need = max(3 * k, int(2 * duration))
    if n < need * rate:
        rate = max(1, n // need)
    seen = [(i, p) for i, p in list(enumerate(video_frames))[::rate] if p is not None and pictures.is_good(p)]
    if len(seen) > k:
        x = np.array([pictures.features(p) for _, p in seen])
        s = x.std(0)
        x = np.where(s > 0, (x - x.mean(0)) / np.where(s > 0, s, 1), 0)
        c = diverse.kmeans(x, k)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        places = sorted(np.flatnonzero(own == j)[d[own == j, j].argmin()] for j in range(k) if (own == j).any())
        seen = [seen[p] for p in places]
    return [(j, i, i / fps, pictures.average_hash(p)) for j, (i, p) in enumerate(seen)]


def test_diverse_selection_against_numpy(spark):
    rng = np.random.default_rng(2)
    videos, rows, want = [], [], {}
    for v, (n, fps) in enumerate([(90, 9.0), (30, 3.0), (12, 4.0), (3, 1.0), (40, 8.0)]):
        scenes = [rng.integers(0, 256, (6, 8, 3)).astype(np.uint8) for _ in range(5)]
        frames = []
        for i in range(n):
            p = np.clip(np.repeat(np.repeat(scenes[i * 5 // n], 6, 0), 6, 1).astype(int) + rng.integers(-8, 9, (36, 48, 3)), 0, 255).astype(np.uint8)
            frames.append(None if i % 17 == 5 else np.zeros_like(p) if i % 13 == 7 else p)
        videos.append((v, fps, n, n / fps))
        rows += [(v, i, 36, 48, 3, None if p is None else p.tobytes()) for i, p in enumerate(frames)]
        want[v] = plain_selection(frames, n / fps, fps, 10)
    videos += [(98, 5.0, 0, 0.0), (99, None, None, None)]
    vs, fs = spark.createDataFrame(videos, "video_id long, fps double, frame_count long, duration double"), spark.createDataFrame(rows, FRAME)
    chosen = pictures.diverse_selection(vs, fs)
    found = {}
    for r in sorted(chosen.collect()):
        found.setdefault(r.video_id, []).append((r.position, r["index"], r.timestamp, r.hash))
    assert found == want and len(want[0]) == 10 and len(want[3]) <= 4
    results = {r.video_id: r for r in pictures.extraction_results(vs, chosen).collect()}
    assert results[0].success and results[0].actual_frames == results[0].target_frames == 10 and results[0].frame_indices == [i for _, i, _, _ in want[0]] and results[0].metadata[0].hash == want[0][0][3]
    assert results[98].success and results[98].actual_frames == 0 and results[98].extraction_density == 0 and results[99].success is False
    assert pictures.diverse_selection(vs, fs.limit(0)).collect() == []


def test_nearest_frame_of_each_cluster(spark):
    """Three tight groups: of each, the frame nearest to its mean."""
    rng = np.random.default_rng(0)
    x = np.concatenate([c + 0.1 * rng.normal(size=(7, 2)) for c in ([0, 0], [9, 0], [0, 9])])
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "video_id int, frame_idx int, embedding array<double>")
    z = (x - x.mean(0)) / x.std(0)
    want = [7 * g + int(((z[7 * g : 7 * g + 7] - z[7 * g : 7 * g + 7].mean(0)) ** 2).sum(1).argmin()) for g in range(3)]
    assert sorted(r.frame_idx for r in diverse.diverse_frames(df, 3).collect()) == want


def test_exponential_fit_finds_the_curve(spark):
    rng = np.random.default_rng(4)
    x = np.arange(1, 25)
    curves = {"u": (5.0, 0.3), "w": (120.0, 0.05), "flat": (3.0, 0.0), "rising": (2.0, -0.04)}
    rows = [(k, float(i), float(y)) for k, (a, b) in curves.items() for i, y in zip(x, a * np.exp(-b * x))]
    noisy = np.maximum(0, 40 * np.exp(-0.2 * x) + rng.normal(0, 1, len(x)))
    rows += [("noisy", float(i), float(y)) for i, y in zip(x, noisy)] + [("one", 1.0, 2.0), ("none", 1.0, None), ("zero", 1.0, 0.0), ("zero", 2.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    found = {r.k: (r.a, r.b) for r in diverse.exponential_fit(df, "k").collect()}
    assert all(found[k] == pytest.approx(ab, rel=1e-6, abs=1e-6) for k, ab in curves.items())
    error = lambda a, b: ((noisy - a * np.exp(-b * x)) ** 2).sum()
    a, b = found["noisy"]
    assert all(error(a, b) <= error(a * p, b * q) + 1e-9 for p in (0.999, 1, 1.001) for q in (0.999, 1, 1.001))
    assert found["one"] == found["zero"] == (None, None) and "none" not in found


def test_ids_without_any_in_common_go_by_order(spark):
    a = spark.createDataFrame([("c", 3), ("a", 1), ("b", 2)], "video_id string, x int")
    b = spark.createDataFrame([("r",), ("p",), ("q",)], "video_id string")
    assert sorted((r.video_id, r.other_video_id, r.x) for r in sampling.common_ids(a, b).collect()) == [("a", "p", 1), ("b", "q", 2), ("c", "r", 3)]
    assert sampling.common_ids(a, b.limit(2)).collect() == []
    assert [r.video_id for r in sampling.common_ids(a, b.union(a.select("video_id").limit(1))).collect()] == ["c"]


def box(kind, *parts, wide=False, size=None):
    body = b"".join(parts)
    if wide:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8 if size is None else size, kind) + body


def mp4(frames=50, delta=512, scale=12800, kind=b"vide", runs=None, wide=False, stsz=True, version=0):
    full = struct.pack(">I", 0)
    runs = [(frames, delta)] if runs is None else runs
    stts = box(b"stts", full, struct.pack(">I", len(runs)), *[struct.pack(">II", *r) for r in runs])
    sizes = box(b"stsz", full, struct.pack(">II", 1000, frames)) if stsz else b""
    ticks = sum(n * d for n, d in runs)
    head = b"\x01\0\0\0" + struct.pack(">QQIQ", 0, 0, scale, ticks) if version else full + struct.pack(">IIII", 0, 0, scale, ticks)
    mdia = box(b"mdia", box(b"mdhd", head, b"\0" * 4), box(b"hdlr", full, full, kind, b"\0" * 13), box(b"minf", box(b"stbl", stts, sizes)))
    return box(b"ftyp", b"isom\0\0\2\0") + box(b"mdat", b"x" * 77, wide=wide) + box(b"moov", box(b"mvhd", b"\0" * 100), box(b"trak", box(b"tkhd", b"\0" * 84), mdia), wide=wide)


def test_video_boxes():
    assert video.probe(mp4()) == (25.0, 50, 2.0, None)
    assert video.probe(mp4(wide=True, version=1, stsz=False)) == (25.0, 50, 2.0, None)
    fps, n, seconds, reason = video.probe(mp4(30, runs=[(10, 400), (20, 600)], scale=1000))
    assert (n, reason) == (30, None) and fps == pytest.approx(30 / 16) and seconds == pytest.approx(16)
    assert video.probe(mp4(0, runs=[])) == (0.0, 0, 0.0, None)
    assert video.probe(mp4(kind=b"soun"))[3] == "no video track"
    assert video.probe(mp4(scale=0))[3] == "no time scale"
    assert video.probe(b"")[3] == video.probe(None)[3] == "empty"
    assert video.probe(box(b"ftyp", b"isom") + box(b"mdat", b"x", size=0))[3] == "no moov box"
    assert video.probe(b"not a video at all, just some text")[3] and video.probe(box(b"free", size=3))[3] == "box of no size"
    whole = mp4()
    assert all(video.probe(whole[:i])[3] for i in range(len(whole)))  # wherever it is cut off
    rng = np.random.default_rng(1)
    for _ in range(500):  # broken bytes give a reason or facts, not a crash
        hurt = bytearray(whole)
        hurt[rng.integers(len(hurt))] = rng.integers(256)
        assert len(video.probe(bytes(hurt))) == 4


def test_video_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.mp4").write_bytes(mp4())
    (tmp_path / "two.MOV").write_bytes(mp4()[:-9])
    (tmp_path / "three.txt").write_bytes(b"no video")
    found = {r.path.rsplit("/", 1)[1]: (r.fps, r.frame_count, r.duration, r.reason) for r in video.video_files(spark, str(tmp_path)).collect()}
    assert found == {"one.mp4": (25.0, 50, 2.0, None), "two.MOV": (None, None, None, "moov cut off")}
