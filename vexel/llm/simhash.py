"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 5 of their 8 positional bytes. The index has
a list for each value of three bytes at once: of any 5 positions, 3 lie in the same half of the fingerprint, so the
8 triples within the halves meet every such pair. Pairs of a list tally their equal positional bytes, those with 5
or more are verified by their differing bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, SEED, NEAR, SHARED = 3, 42, 3, 5
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]
#: Longer lists are divided by two more shared bytes, and those that are still longer by masks of NEAR bits.
LONG = 2048
BLOCK = 1 << 15


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text; 0 without words."""
    ws = text.lower().split()  # for bytes: A-Z, and white space of ASCII
    if not ws:
        return 0
    shingles = list(map(b" ".join, zip(*(ws[i:] for i in range(words))))) or [b" ".join(ws)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(shingles), BLOCK):
        part = shingles[i : i + BLOCK]
        h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in part), ">u8", len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, sha256 of the text) of whole texts; null counts as empty."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in texts], pa.int64()), b.column(2)], ["doc_id", "fp", "sha256"])

    common.small_batches(docs.sparkSession)
    rows = common.keyed(docs, id_col, text_col).select("id", "text", F.sha2("text", 256).alias("sha256"))
    return rows.mapInArrow(run, "doc_id long, fp long, sha256 string")


def _byte(position: int) -> F.Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _packed(positions: tuple[int, ...]) -> F.Column:
    out = F.lit(0).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(p))
    return out


def _forest(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within equal keys (sorted) that connect what is linked: places of the ends. No pair leaves the task
    whose ends are connected already."""
    n = len(key)
    root = np.arange(n)
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            x = int(root[x])
        return x

    ends = np.searchsorted(key, key, "right")  # of the run of each place
    at, step = np.arange(n), 1
    while True:
        at = at[at + step < ends[at]]
        if not len(at):
            break
        i = at[root[at] != root[at + step]]
        x = fp[i] ^ fp[i + step]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)  # the tally
        i, x = i[shared >= SHARED], x[shared >= SHARED]
        i = i[np.bitwise_count(x) <= NEAR]
        for a in i.tolist():
            r, s = find(a), find(a + step)
            if r != s:
                root[max(r, s)] = min(r, s)
                out.append((a, a + step))
        if len(i):
            while not np.array_equal(up := root[root], root):
                root = up
        step += 1
    ab = np.array(out, np.int64).reshape(-1, 2)
    return ab[:, 0], ab[:, 1]


def _link_lists(lists: DataFrame) -> DataFrame:
    """Links (u, v) of lists (key, fp) of at most LONG entries each."""

    def run(batches):
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(k, f):
            a, b = _forest(k, f)
            return pa.RecordBatch.from_arrays([pa.array(f[a], pa.int64()), pa.array(f[b], pa.int64())], ["u", "v"])

        for batch in batches:
            k = np.concatenate((held_k, batch.column(0).to_numpy(zero_copy_only=False)))
            f = np.concatenate((held_f, batch.column(1).to_numpy(zero_copy_only=False)))
            cut = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0  # the last list may go on
            held_k, held_f = k[cut:], f[cut:]
            if cut:
                yield links(k[:cut], f[:cut])
        if len(held_k):
            yield links(held_k, held_f)

    return lists.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def _split(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists of 2 to LONG entries, and longer ones."""
    sizes = lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = lists.join(sizes, "key")
    return sized.where(F.col("n") <= LONG).select("key", "fp"), sized.where(F.col("n") > LONG).select("key", "fp")


def links(prints: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints `fp` of at most NEAR differing bits that connect all linked ones.

    Every pair of linked fingerprints is connected by the links given; the pairs themselves are not expanded.
    """
    spark = prints.sparkSession
    triple = F.explode(F.array(*[F.struct(_packed(t).bitwiseOR(F.lit(i << 24)).alias("key"), F.lit(i).alias("i")) for i, t in enumerate(TRIPLES)]))
    lists = prints.select(triple.alias("t"), "fp").select("t.key", "fp")
    short, long = _split(lists)
    found = _link_lists(short)
    long = common.stored(long)
    if long.isEmpty():
        return found
    # Pairs share two more bytes besides those of the key.
    rest = [[p for p in range(8) if p not in t] for t in TRIPLES]
    pairs = [F.array(*[_packed((*t, *two)).bitwiseOR(F.shiftleft(F.lit(10 * i + j).cast("long"), 40)) for j, two in enumerate(combinations(rest[i], 2))]) for i, t in enumerate(TRIPLES)]
    which = F.shiftright("key", 24)
    keys = F.array(*pairs)[which.cast("int")]
    short, long = _split(long.select(F.explode(keys).alias("key"), "fp").distinct())
    found = found.unionByName(_link_lists(short))
    long = common.stored(long)
    if long.isEmpty():
        return found
    # What agrees in five bytes and outside NEAR masked bits of the other three is linked with each other: a star
    # links it, without pairs. The table of masks has a fixed size.
    masks = []
    for i, t in enumerate(TRIPLES):
        for j, two in enumerate(combinations(rest[i], 2)):
            bits = [8 * p + b for p in range(8) if p not in t and p not in two for b in range(8)]
            masks += [(10 * i + j, int(np.uint64(sum(1 << x for x in c)).astype(np.int64))) for c in combinations(bits, NEAR)]
    table = spark.createDataFrame(masks, "which long, mask long")
    masked = long.withColumn("which", F.shiftright("key", 40)).join(F.broadcast(table), "which").select("key", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest"), "fp")
    star = masked.groupBy("key", "mask", "rest").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    return found.unionByName(masked.join(star, ["key", "mask", "rest"]).where("fp <> v").select(F.col("fp").alias("u"), "v").distinct())


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, sha256, component_id)."""
    prints = common.stored(fingerprints(docs, id_col, text_col))
    groups = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(groups.select("fp")))
    roots = groups.join(joined, groups.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints of at most 3 differing bits link, and component_id is the
    smallest doc_id of all that are connected.

    One row for each row of docs. Null text: fingerprint zero. Rows without a doc_id have their component's
    smallest id, null if no row of it has one. Other columns are ignored.
    """
    found = _grouped(docs, id_col, text_col)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their own component; rows without an id stay. Columns as they were.

    A row is known by its id and text, so of rows with one id and several texts each stands or goes by itself.
    """
    drop = _grouped(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("sha256").alias("_sha256")).distinct()
    sha256 = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    return docs.join(drop, (F.col(id_col).cast("long") == F.col("_id")) & (sha256 == F.col("_sha256")), "left_anti").select(docs.columns)
