"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by documents: each shard holds, for every term of its documents, the ordered list of its
positions, delta coded. It is stored once; searches read the shards and take in each the rarest term of a phrase
first, then intersect the offset-adjusted lists of the others. No list crosses shards, so no hot term does.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A-Z become a-z, and all but 0-9, a-z and bytes of non-ASCII characters become spaces: split() then gives the words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW = 10
SHARD = 8 << 20  # bytes of text in a shard
SLICE = 1 << 20  # bytes of a text that are split at once
QUERY_BYTES = 32 << 20  # of the windows in one broadcast; more windows are searched block by block

INDEX = "shard string, doc_id array<long>, n_words array<long>, terms binary, counts binary, postings binary"


def word_slices(text: bytes):
    """Lists of the words of a text, in order; a list holds about SLICE bytes of a long one."""
    folded = text.translate(FOLD)
    if len(folded) <= SLICE:
        yield folded.split()
        return
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def words(text: bytes) -> list[bytes]:
    return [w for part in word_slices(text) for w in part]


class Terms(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, one row for each shard. Null texts have no words; repeated rows are documents of their own. Shards
    are named anew at each run, so an index that is searched more than once has to be stored."""

    def shard(ids: list, texts: list[bytes]):
        terms = Terms()
        number, seqs, n_words = terms.__getitem__, [], []
        for text in texts:
            n = 0
            for part in word_slices(text):
                seqs.append(np.fromiter(map(number, part), np.int32, len(part)))
                n += len(part)
            n_words.append(n)
        seq = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
        lens = np.array(n_words, np.int64)
        pos = np.arange(len(seq)) + np.repeat(np.arange(len(lens)), lens)  # a free place after each document
        by = np.argsort(seq, kind="stable")
        counts = np.bincount(seq, minlength=len(terms))
        delta = np.diff(pos[by], prepend=0)
        first = np.cumsum(counts) - counts
        delta[first] = pos[by][first]
        return [uuid.uuid4().hex, ids, n_words, b" ".join(terms), counts.astype("<u4").tobytes(), delta.astype("<u4").tobytes()]

    def run(batches):
        for held in common.buffered(batches, SHARD):
            row = shard(held["id"], held["text"])
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["shard", "doc_id", "n_words", "terms", "counts", "postings"])

    common.small_batches(docs.sparkSession)
    return common.keyed(docs, id_col, text_col).mapInArrow(run, INDEX)


class Shard:
    """Posting lists of an index row."""

    def __init__(self, row: dict):
        self.ids, self.n_words = row["doc_id"], np.array(row["n_words"], np.int64)
        self.starts = np.cumsum(self.n_words + 1) - self.n_words - 1
        self.counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        total = np.cumsum(np.frombuffer(row["postings"], "<u4").astype(np.int64))
        base = total[self.first] - np.frombuffer(row["postings"], "<u4")[self.first] if len(total) else total
        self.places = total - np.repeat(base, self.counts)
        self.width = int(self.starts[-1] + self.n_words[-1] + 2) if len(self.ids) else 1
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.width + self.places
        self.terms = row["terms"].split(b" ") if row["terms"] else []

    def of(self, vocabulary: dict[bytes, int]) -> np.ndarray:
        """For each term of the queries its number in this shard, -1 if it has none."""
        out = np.full(len(vocabulary) + 1, -1)
        for i, t in enumerate(self.terms):
            if (q := vocabulary.get(t)) is not None:
                out[q] = i
        return out

    def held(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each place is in its term's list."""
        key = term * self.width + place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (place >= 0)

    def lists(self, which: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The whole lists of some terms: the query and the place of each entry."""
        n = self.counts[term]
        return np.repeat(which, n), common.ragged(self.places, self.first[term], n)

    def phrases(self, queries: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact matches of word sequences (rows of term numbers of this shard, as long as lens): query and place."""
        real = np.arange(queries.shape[1]) < lens[:, None]
        able = np.flatnonzero(((queries >= 0) | ~real).all(1))
        none = np.zeros(0, np.int64)
        if not len(able) or not len(self.keys):
            return none, none
        counts = np.where(real[able], self.counts[np.where(real[able], queries[able], 0)], np.iinfo(np.int64).max)
        rarest_first = np.argsort(counts, axis=1, kind="stable")
        k = rarest_first[:, 0]
        which, place = self.lists(np.arange(len(able)), queries[able, k])
        place = place - k[which]
        for step in range(1, queries.shape[1]):
            k = rarest_first[which, step]
            more = step < lens[able[which]]
            keep = ~more | self.held(queries[able[which], k], place + k)
            which, place = which[keep], place[keep]
            if not len(which):
                break
        return able[which], place

    def near(self, terms: np.ndarray, distance: int) -> np.ndarray:
        """Places of the first term that have each other term, the rarest tried first, within `distance` words of
        the same document."""
        if not len(terms) or (terms < 0).any():
            return np.zeros(0, np.int64)
        others = terms[1:][np.argsort(self.counts[terms[1:]], kind="stable")]
        place = self.lists(np.zeros(1, np.int64), terms[:1])[1]
        doc = np.searchsorted(self.starts, place, "right") - 1
        low = np.maximum(place - distance, self.starts[doc])
        high = np.minimum(place + distance, self.starts[doc] + self.n_words[doc] - 1)
        for t in others:
            at = np.minimum(np.searchsorted(self.keys, t * self.width + low), len(self.keys) - 1)
            keep = (self.keys[at] >= t * self.width + low) & (self.keys[at] <= t * self.width + high)
            place, low, high = place[keep], low[keep], high[keep]
        return place


def windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(words binary, items array<long>): the distinct windows of all items, words joined by spaces."""

    def run(batches):
        for b in batches:
            ids, out = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(text)
                own = {b" ".join(ws[j : j + window]) for j in range(max(1, len(ws) - window + 1))} if ws else set()
                ids += [i] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["item_id", "words"])

    found = common.keyed(benchmark, id_col, text_col).mapInArrow(run, "item_id long, words binary")
    return found.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _blocks(found: DataFrame):
    """The windows in blocks whose size is checked: lists of rows to broadcast."""
    stored = common.stored(found)
    size = stored.agg(F.sum(F.length("words") + 8 * F.size("items") + 64)).first()[0] or 0
    n = int(size // QUERY_BYTES) + 1
    for i in range(n):
        block = stored if n == 1 else stored.where(F.pmod(F.xxhash64("words"), F.lit(n)) == i)
        yield [(bytes(r.words), list(r.items)) for r in block.collect()]


def _query(rows: list) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, list]:
    vocabulary = Terms()
    split = [w.split(b" ") for w, _ in rows]
    table = np.full((len(rows), max([1, *map(len, split)])), -1)
    for i, ws in enumerate(split):
        table[i, : len(ws)] = [vocabulary[w] for w in ws]
    return dict(vocabulary), table, np.array([len(ws) for ws in split], np.int64), [items for _, items in rows]


def exact_matches(index: DataFrame, found: DataFrame) -> DataFrame:
    """Where windows occur: shard, place (of the document in it), doc_id, n_words, spans array<struct<start, length>>
    of hit words (disjoint, ordered) and items array<long>; one row for each document and block of windows."""
    spark = index.sparkSession
    kind = "shard string, place long, doc_id long, n_words long, spans array<struct<start:long,length:long>>, items array<long>"
    spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def search(query):
        def run(batches):
            vocabulary, table, lens, items = query.value
            sizes = np.array([len(x) for x in items], np.int64)
            flat = np.array([i for x in items for i in x], np.int64)
            first = np.cumsum(sizes) - sizes
            for batch in batches:
                for row in batch.to_pylist():
                    s = Shard(row)
                    own = s.of(vocabulary)
                    which, place = s.phrases(own[table], lens) if len(lens) else (np.zeros(0, np.int64),) * 2
                    doc = np.searchsorted(s.starts, place, "right") - 1
                    cover = np.zeros(s.width + 1, np.int64)
                    np.add.at(cover, place, 1)
                    np.add.at(cover, place + lens[which], -1)
                    edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
                    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    begin_doc = np.searchsorted(s.starts, begin, "right") - 1
                    spans: dict[int, list] = {}
                    for d, b, e in zip(begin_doc.tolist(), (begin - s.starts[begin_doc]).tolist(), (end - begin).tolist()):
                        spans.setdefault(d, []).append({"start": b, "length": e})
                    hit: dict[int, set] = {}
                    for d, i in zip(np.repeat(doc, sizes[which]).tolist(), common.ragged(flat, first[which], sizes[which]).tolist()):
                        hit.setdefault(d, set()).add(i)
                    n = len(s.ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["shard"]] * n), pa.array(range(n), pa.int64()), pa.array(s.ids, pa.int64()), pa.array(s.n_words, pa.int64()),
                         pa.array([spans.get(d, []) for d in range(n)], spans_kind), pa.array([sorted(hit.get(d, ())) for d in range(n)], pa.list_(pa.int64()))],
                        ["shard", "place", "doc_id", "n_words", "spans", "items"],
                    )

        return run

    common.small_batches(spark)
    blocks = [index.mapInArrow(search(spark.sparkContext.broadcast(_query(rows))), kind) for rows in _blocks(found)]
    if len(blocks) == 1:
        return blocks[0]
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)

    def merged(batches):
        for batch in batches:
            for row in batch.to_pylist():
                spans: list[dict] = []
                for x in sorted(row["spans"], key=lambda x: x["start"]):
                    if spans and x["start"] <= (end := spans[-1]["start"] + spans[-1]["length"]):
                        spans[-1]["length"] = max(end, x["start"] + x["length"]) - spans[-1]["start"]
                    else:
                        spans.append(dict(x))
                yield pa.RecordBatch.from_pylist([row | {"spans": spans, "items": sorted(set(row["items"]))}], batch.schema)

    joined = out.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return joined.mapInArrow(merged, kind)


def proximity_matches(index: DataFrame, terms: list[str], distance: int) -> DataFrame:
    """(doc_id, position): places of the first term that have all other terms within `distance` words."""
    wanted = {w: i for i, w in enumerate(dict.fromkeys(w for t in terms for w in words(t.encode())))}

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row)
                place = s.near(s.of(wanted)[:-1], distance)
                doc = np.searchsorted(s.starts, place, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([s.ids[d] for d in doc.tolist()], pa.int64()), pa.array(place - s.starts[doc], pa.int64())], ["doc_id", "position"])

    return index.mapInArrow(run, "doc_id long, position long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside an occurrence of `window` consecutive words of an item, or of a shorter item as a whole. Null
    and wordless texts have zeros; a null item_id hits but is not listed; repeated rows give repeated results. The
    index is stored in the shared folder.
    """
    index = common.stored(build_index(docs, id_col, text_col))
    found = exact_matches(index, windows(benchmark, window, item_col, item_text))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose own text isn't contaminated, whatever their ids. Columns as they were.

    A row is known by a 64-bit hash of its id and text, so other rows with its id don't count.
    """
    row = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(row.alias("doc_id"), F.col(text_col).alias("text"))
    hit = contamination(rows, benchmark).where("contaminated").select(F.col("doc_id").alias("_hit")).distinct()
    return docs.withColumn("_row", row).join(hit, F.col("_row") == F.col("_hit"), "left_anti").select(docs.columns)
