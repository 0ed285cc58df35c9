"""Stupid-backoff language-model scores (Brants et al. 2007) from n-gram counts of the whole corpus.

Documents are packed into blocks, which are stored bucketed by block, so that no join shuffles them. For each order a
block explodes into its distinct n-grams, which are dealt by hash to the parts of that order's count table; a part
sums the counts of all blocks and joins them to the n-grams that each block asked for. So a frequent n-gram reaches
its part once for each block. All n-grams count; a caller may ask for a floor `cut`, below which those of two words and
more count as unseen: then an n-gram can only be seen if both of its shorter n-grams are, and no others are exploded.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontam import Terms, word_slices

ORDER, ALPHA, CUT = 3, 0.4, 1
BLOCK = 4 << 20  # bytes of text in a block
BLOCKS = "block string, doc_id array<long>, n_words array<long>, hashes binary, tokens binary"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each block: its documents, the 64-bit hashes of its distinct words, and its text in their numbers."""

    def run(batches):
        for held in common.buffered(batches, BLOCK):
            terms, seqs, n_words = Terms(), [], []
            for text in held["text"]:
                n = 0
                for part in word_slices(text):
                    seqs.append(np.fromiter(map(terms.__getitem__, part), np.uint32, len(part)))
                    n += len(part)
                n_words.append(n)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms))
            tokens = np.concatenate(seqs) if seqs else np.zeros(0, np.uint32)
            row = [uuid.uuid4().hex, held["id"], n_words, hashes.tobytes(), tokens.tobytes()]
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["block", "doc_id", "n_words", "hashes", "tokens"])

    common.small_batches(docs.sparkSession)
    return common.keyed(docs, id_col, text_col).mapInArrow(run, BLOCKS)


class Block:
    """The n-grams of a block, up to the orders whose counts are known."""

    def __init__(self, row: dict):
        self.ids, self.lens = row["doc_id"], np.array(row["n_words"], np.int64)
        words = np.frombuffer(row["hashes"], np.uint64)
        self.keys = words[np.frombuffer(row["tokens"], np.uint32)]  # of the n-gram that starts at each place
        self.first = self.keys
        n = len(self.keys)
        self.room = np.repeat(np.cumsum(self.lens), self.lens) - np.arange(n)  # words of the document from here on
        self.counts: list[np.ndarray] = []
        self.asked = np.arange(n)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct n-grams asked for, their number here, and for each place asked which it has."""
        keys, which, n = np.unique(self.keys[self.asked], return_inverse=True, return_counts=True)
        return keys, which, n

    def learn(self, counts: np.ndarray, cut: int) -> None:
        """Takes the corpus counts of the distinct n-grams of this order and goes on to the next."""
        _, which, _ = self.distinct()
        full = np.zeros(len(self.keys), np.int64)
        full[self.asked] = counts[which]
        if self.counts:
            full[full < cut] = 0
        self.counts.append(full)
        order = len(self.counts) + 1
        seen = full >= cut
        at = np.flatnonzero(seen[:-1] & seen[1:]) if len(seen) else np.zeros(0, np.int64)
        self.asked = at[self.room[at] >= order]
        if len(self.keys):
            after = np.append(self.first[order - 1 :], np.zeros(order - 1, np.uint64))[: len(self.keys)]
            mixed = (self.keys ^ (self.keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + after
            self.keys = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def scores(self, total: int, alpha: float) -> np.ndarray:
        """ln S of each word given those before it."""
        n = len(self.first)
        place = np.repeat(self.lens, self.lens) - self.room  # of each word in its document
        out = np.log(self.counts[0] / max(total, 1))
        for order in range(2, len(self.counts) + 1):
            back = order - 1
            at = np.flatnonzero(place >= back)
            start = at - back
            top, under = self.counts[order - 1][start], self.counts[order - 2][start]
            seen = top > 0
            new = np.log(alpha) + out[at]
            new[seen] = np.log(top[seen] / under[seen])
            out[at] = new
        return out


def _opened(row: dict, orders: int, cut: int) -> Block:
    block = Block(row)
    for k in range(1, orders + 1):
        got = sorted(row[f"counts{k}"] or [], key=lambda x: x["part"])
        parts = [_wide(x["counts"]) for x in got]
        keys = block.distinct()[0]
        counts = np.zeros(len(keys), np.int64)
        if parts:
            by = np.argsort(_part(keys, row["parts"]), kind="stable")
            counts[by] = np.concatenate(parts)
        block.learn(counts, cut)
    return block


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)


def _ask(known: DataFrame, k: int, parts: int, cut: int) -> DataFrame:
    """Rows (part, block, keys, n): the distinct n-grams of order k of each block, dealt by hash."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, _, n = _opened(row | {"parts": parts}, k - 1, cut).distinct()
                part = _part(keys, parts)
                by = np.argsort(part, kind="stable")
                own, first = np.unique(part[by], return_index=True)
                dealt = [pa.array([x.tobytes() for x in np.split(v[by], first[1:])][: len(own)], pa.binary()) for v in (keys, n.astype("<u4"))]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([row["block"]] * len(own), pa.string()), *dealt], ["part", "block", "keys", "n"])

    return known.mapInArrow(run, "part int, block string, keys binary, n binary")


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Joins a part of the count table to the n-grams that blocks asked for."""
    asked = [np.frombuffer(x, np.uint64) for x in pdf["keys"]]
    table, which = np.unique(np.concatenate(asked), return_inverse=True)
    n = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["n"]])
    sums = np.zeros(len(table), np.int64)
    np.add.at(sums, which, n.astype(np.int64))
    ends = np.cumsum([len(x) for x in asked])[:-1]
    return pd.DataFrame({"part": pdf["part"], "block": pdf["block"], "counts": [_narrow(x) for x in np.split(sums[which], ends)]})


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in 4 bytes each, or in 8 if one needs them, after a byte that says so."""
    size = 8 if counts.max(initial=0) >> 32 else 4
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, cut: int = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, score (sum of ln S over its words) and mean_score (null without words).

    S is count(n-gram) / count(its context) where the n-gram is seen, else alpha times S of the shorter n-gram, and
    for one word its share of all words. Words are those of decontam.words; null texts have none; repeated rows count
    as often as they stand. N-grams are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    name = f"vexel_lm_{uuid.uuid4().hex}"
    packed = pack(docs, id_col, text_col)
    buckets = 2 * common.parts(spark)
    common.put_table(packed, name, buckets, "block")
    blocks = spark.table(name)
    total = blocks.select(F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = max(buckets, total // 1_000_000)
    common.small_batches(spark)
    known = blocks
    for k in range(1, order + 1):
        asked = _ask(known, k, parts, cut)
        answers = asked.groupBy("part").applyInPandas(_count, "part int, block string, counts binary")
        own = answers.groupBy("block").agg(F.collect_list(F.struct("part", "counts")).alias(f"counts{k}"))
        common.put_table(own, f"{name}_{k}", buckets, "block")
        common.let_go(spark)  # the exchange isn't needed any more
        known = known.join(spark.table(f"{name}_{k}"), "block", "left")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _opened(row | {"parts": parts}, order, cut)
                own = np.append(0, np.cumsum(block.scores(total, alpha)))
                ends = np.append(0, np.cumsum(block.lens))
                sums = own[ends[1:]] - own[ends[:-1]]
                mean = [s / n if n else None for s, n in zip(sums.tolist(), block.lens.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(block.lens), pa.array(sums), pa.array(mean, pa.float64())], ["doc_id", "n_words", "score", "mean_score"])

    return known.mapInArrow(run, "doc_id long, n_words long, score double, mean_score double")
