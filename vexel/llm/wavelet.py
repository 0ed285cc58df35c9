"""Token-id shards as wavelet matrices (Claude and Navarro 2012).

A shard's ids are cut into bits, highest first: a plane holds one bit of each id, and the next plane has the ids in a
stable order by that bit. With running counts of ones a plane answers rank and select, so one compressed file gives any
token, counts a token up to a place and finds its occurrences. Shards are stored as one Parquet file each.
"""

from __future__ import annotations

import zlib
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

SHARD = 8 << 20  # bytes of text in a shard
STEP = 512  # bits between running counts
END = 0  # the id after each document
FORMAT = "part int, shard int, start long, doc_id array<long>, n_tokens array<long>, n long, planes array<binary>, ones array<binary>, zeros array<long>"


class WaveletMatrix:
    """Bit planes of n ids with their running counts of ones and numbers of zeros."""

    def __init__(self, n: int, planes: list[bytes], ones: list[bytes], zeros: list[int]):
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ones = [np.frombuffer(o, "<u4").astype(np.int64) for o in ones]

    @classmethod
    def of(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, ones, zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (x >> level & 1).astype(bool)
            plane = np.packbits(bit, bitorder="little")
            per = np.bitwise_count(np.append(plane, np.zeros(-len(plane) % (STEP // 8), np.uint8))).reshape(-1, STEP // 8).sum(1, dtype=np.int64)
            planes.append(plane.tobytes())
            ones.append(np.append(0, np.cumsum(per)).astype("<u4").tobytes())
            zeros.append(int(len(x) - per.sum()))
            x = np.concatenate((np.compress(~bit, x), np.compress(bit, x)))
        return cls(len(ids), planes, ones, zeros)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)

    def ids(self) -> np.ndarray:
        """All ids, by undoing the planes' orders from the lowest bit up."""
        x = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = self._bits(level)
            back = np.empty_like(x)
            one = len(self.planes) - 1 - level
            back[np.flatnonzero(~bit)] = x[: self.zeros[level]]
            back[np.flatnonzero(bit)] = x[self.zeros[level] :] | x.dtype.type(1 << one)
            x = back
        return x

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // STEP
        held = self.planes[level][block * (STEP // 8) : (i + 7) // 8]
        ones = int(self.ones[level][block]) + int(np.bitwise_count(held).sum())
        if i % 8 and len(held):
            ones -= (int(held[-1]) >> i % 8).bit_count()
        return ones

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> i % 8 & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, zeros in enumerate(self.zeros):
            bit, one = self._bit(level, i), self._rank1(level, i)
            i = zeros + one if bit else i - one
            out = out << 1 | bit
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before place `end` stand below the last plane."""
        low, high, bits = 0, end, len(self.planes)
        if token >> bits:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank1(level, low), self._rank1(level, high)
            low, high = (zeros + a, zeros + b) if token >> (bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token before place `end`."""
        low, high = self._range(token, self.n if end is None else end)
        return high - low

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero of a plane."""
        counts = self.ones[level] if bit else np.minimum(np.arange(len(self.ones[level])) * STEP, self.n) - self.ones[level]
        block = int(np.searchsorted(counts, k, "right")) - 1
        part = self.planes[level][block * (STEP // 8) : (block + 1) * (STEP // 8)]
        own = np.unpackbits(part, bitorder="little", count=min(8 * len(part), self.n - block * STEP))
        return block * STEP + int(np.flatnonzero(own == bit)[k - int(counts[block])])

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence, from 0."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at, bits = low + k, len(self.planes)
        for level in range(bits - 1, -1, -1):
            bit = token >> (bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        """All places of a token, in order: those below the last plane are traced back plane by plane, all at once."""
        low, high = self._range(token, self.n)
        at, bits = np.arange(low, high), len(self.planes)
        for level in range(bits - 1, -1, -1):
            if not len(at):
                break
            bit = token >> (bits - 1 - level) & 1
            places = np.flatnonzero(self._bits(level) == bool(bit))
            at = places[at - self.zeros[level] if bit else at]
        return at.tolist()


def opened(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n"], row["planes"], row["ones"], row["zeros"])


_encoders: dict[str, bpe.Encoder] = {}


def library_encoder(path: str) -> bpe.Encoder:
    """The tokenizers library's model, asked once for each new pretoken in the printable form of its bytes."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path).model
        vocabulary = bpe.Vocabulary(path)
        shown = np.zeros(256, "<u2")
        for c, b in bpe.byte_chars().items():
            shown[b] = ord(c)
        apart = chr(shown[255])

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if not words:
                return np.zeros(0, np.int32), np.zeros(0, np.int64)
            raw = np.frombuffer("\udcff".join(words).encode("utf-8", "surrogateescape"), np.uint8)  # UTF-8 has no byte 255
            got = list(map(model.tokenize, shown[raw].tobytes().decode("utf-16-le").split(apart)))
            lens = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter(map(attrgetter("id"), chain.from_iterable(got)), np.int32, int(lens.sum())), lens

        _encoders[path] = bpe.Encoder(vocabulary.special, vocabulary.split, encode)
    return _encoders[path]


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts, END after each, in ascending order of id (nulls first; equal ids by a hash of the text, then by text, so that many rows of one id go to several parts) as one
    file for each shard. Null texts have only END. `start` counts the part's ids before the shard; parts follow in order."""
    spark = docs.sparkSession

    def run(batches):
        encoder = library_encoder(tokenizer)
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        for held in common.buffered(batches, SHARD):
            ids, lens = encoder.texts(held["text"])
            full = np.full(len(ids) + len(lens), END, np.int32)
            stops = np.cumsum(lens + 1) - 1
            body = np.ones(len(full), bool)
            body[stops] = False
            full[body] = ids
            m = WaveletMatrix.of(full)
            row = [part, shard, start, held["id"], lens + 1, m.n, [p.tobytes() for p in m.planes], [o.astype("<u4").tobytes() for o in m.ones], m.zeros]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["part", "shard", "start", "doc_id", "n_tokens", "n", "planes", "ones", "zeros"])
            shard, start = shard + 1, start + m.n

    common.small_batches(spark)
    rows = common.keyed(docs, id_col, text_col, binary=False).withColumn("hash", F.xxhash64("text"))
    rows = rows.repartitionByRange(2 * common.parts(spark), "id", "hash").sortWithinPartitions("id", "hash", "text").drop("hash")
    rows.mapInArrow(run, FORMAT).write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The shards at `path`, with `start` counted over all parts."""
    rows = spark.read.schema(FORMAT).parquet(path)
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each part
    base = rows.groupBy("part").agg(F.sum("n").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("start") + F.col("base")).drop("base")


def checksums(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = opened(row).ids().astype("<u4")
                lens = np.array(row["n_tokens"], np.int64)
                ends = np.cumsum(lens)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lens.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(row["start"] + ends - lens), pa.array(lens), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    common.small_batches(shards.sparkSession)
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def find(shards: DataFrame, token: int) -> DataFrame:
    """(start, place): occurrences of a token, by the place in its shard; `start` tells the shard's first place."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = opened(row).occurrences(token)
                yield pa.RecordBatch.from_arrays([pa.array([row["start"]] * len(at), pa.int64()), pa.array(at, pa.int64())], ["start", "place"])

    return shards.mapInArrow(run, "start long, place long")


def stored_ids(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards of docs to `path` (a new shared folder by default) and gives checksums() of what it reads back.

    One row for each row of docs; repeated rows and null ids are kept; an empty table gives no rows.
    """
    path = path or common.shared_dir(docs.sparkSession)
    write(docs, path, tokenizer, id_col, text_col)
    return checksums(read(docs.sparkSession, path))
