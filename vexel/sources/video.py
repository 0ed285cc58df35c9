"""Facts about MP4 and QuickTime files from their boxes, without decoding: fps, frame_count, duration, or a reason.

A file is a sequence of boxes, some of which hold boxes. The video track's media header has its time scale and length,
its sample tables the number of frames and their durations.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE = "fps double, frame_count long, duration double, reason string"
MAX_BOXES = 100_000  # of one level; a file with more is taken as broken


class Unreadable(ValueError):
    """Why a file can't be probed."""


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the contents of the boxes between two places."""
    for _ in range(MAX_BOXES):
        if start == end:
            return
        if end - start < 8:
            raise Unreadable("box cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise Unreadable("box cut off")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:  # to the end
            size = end - start
        if size < head:
            raise Unreadable("box of no size")
        if start + size > end:
            raise Unreadable(f"{kind.decode('latin-1')} cut off")
        yield kind, start + head, start + size
        start += size
    raise Unreadable("too many boxes")


def child(data: memoryview, within: tuple[int, int], *path: bytes) -> tuple[int, int] | None:
    """The contents of the first box of each kind along a path."""
    for kind in path:
        found = next(((s, e) for k, s, e in boxes(data, *within) if k == kind), None)
        if found is None:
            return None
        within = found
    return within


def _table(data: memoryview, at: tuple[int, int], entry: str) -> list[tuple]:
    (count,) = struct.unpack_from(">I", data, at[0] + 4)
    size = struct.calcsize(entry)
    if at[0] + 8 + count * size > at[1]:
        raise Unreadable("sample table cut off")
    return list(struct.iter_unpack(entry, data[at[0] + 8 : at[0] + 8 + count * size]))


def _track(data: memoryview, trak: tuple[int, int]) -> tuple[float, int, float] | None:
    """fps, frames and seconds of a video track; none for other tracks."""
    mdia = child(data, trak, b"mdia")
    kind = mdia and child(data, mdia, b"hdlr")
    if not kind or bytes(data[kind[0] + 8 : kind[0] + 12]) != b"vide":
        return None
    head = child(data, mdia, b"mdhd")
    stbl = child(data, mdia, b"minf", b"stbl")
    if not head or not stbl:
        raise Unreadable("video track without header or tables")
    wide = data[head[0]] == 1
    scale, length = struct.unpack_from(">IQ", data, head[0] + 20) if wide else struct.unpack_from(">II", data, head[0] + 12)
    if not scale:
        raise Unreadable("no time scale")
    times, sizes = child(data, stbl, b"stts"), child(data, stbl, b"stsz")
    runs = _table(data, times, ">II") if times else []
    frames = struct.unpack_from(">I", data, sizes[0] + 8)[0] if sizes else sum(n for n, _ in runs)
    ticks = sum(n * d for n, d in runs) or length
    fps = frames * scale / ticks if ticks else 0.0
    return fps, frames, frames / fps if fps > 0 else 0.0


def probe(content: bytes | None) -> tuple[float | None, int | None, float | None, str | None]:
    """fps, frame_count, duration and reason of a file's bytes. Duration is frame_count / fps, 0 where fps is 0; all three
    are null where the file can't be probed, and reason says why."""
    try:
        if not content:
            raise Unreadable("empty")
        data = memoryview(content)
        moov = child(data, (0, len(data)), b"moov")
        if not moov:
            raise Unreadable("no moov box")
        for kind, start, end in boxes(data, *moov):
            if kind == b"trak" and (found := _track(data, (start, end))):
                return *found, None
        raise Unreadable("no video track")
    except (Unreadable, struct.error, IndexError) as e:
        return None, None, None, str(e) if isinstance(e, Unreadable) else "box cut off"


def probed(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds fps, frame_count, duration and reason to rows with a file's bytes, and drops these."""
    names = [c for c in files.columns if c != content]

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            found = [probe(x.as_buffer() if x.is_valid else None) for x in t.column(content).combine_chunks()]
            kinds = (pa.float64(), pa.int64(), pa.float64(), pa.string())
            extra = [pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)]
            yield from pa.Table.from_arrays([*[t.column(c) for c in names], *extra], [*names, "fps", "frame_count", "duration", "reason"]).to_batches()

    out = files.select(*names).schema
    for name, kind in (p.split() for p in PROBE.split(", ")):
        out = out.add(name, kind)
    return files.select(*names, content).mapInArrow(run, out)


def video_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, fps, frame_count, duration, reason) of the video files below a folder, by Spark's reader of binary
    files: a task reads whole files, of 2 GB at most."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return probed(files.where(F.lower("path").rlike(r"\.(mp4|m4v|mov)$")).select("path", "length", "content"))
