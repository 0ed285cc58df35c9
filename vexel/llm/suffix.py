"""Exact removal of repeated byte strings by a distributed difference-cover suffix array.

Any two equal strings of LENGTH bytes have the same least hash of GRAM bytes at the same place (an anchor). So the
suffixes to be sorted are partitioned by anchor: equal strings meet in one part. Only anchors that two documents may share
are followed; their surroundings (contexts) are sent to the parts, and of equal ones, by their bytes, one is sorted. A
part sorts its contexts' suffixes as the difference-cover algorithm (Kärkkäinen and Sanders 2003) does: it sorts the
triples at the places that 3 does not divide, recurses on their names, merges the other suffixes in, and compares the
prefixes of neighbours. Hashes only say who meets whom; bytes decide.

An anchor with very many occurrences would make a part too large. Its strings are grouped as rows instead: each block
gives every distinct one once, with its least document, and Spark's partial sums find the least of all.

A document whose whole text a smaller document has goes whole, and is found by its SHA-256 before: it has no string that
the smaller one has not, so nothing else hangs on it, and neither its anchors nor, for its sake, those of the other are followed.

Documents are packed into blocks that are stored bucketed by block; only hashes, contexts and verdicts are shuffled.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 50
GRAM = 24
REACH = LENGTH - GRAM  # an anchor starts at most so far behind a string that holds it
BLOCK = 4 << 20  # bytes of text in a block
PIECE = 1 << 18  # strings looked at at once
HOT = 4096  # occurrences of an anchor whose contexts are sorted in one part; strings of hotter ones are grouped as rows
ROWS = 20_000  # strings in one batch
BLOCKS = "block string, doc_id array<long>, lens array<long>, text binary"
PLACE = np.uint64(0xFFFFFF)


def _words(a: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places on."""
    return np.lib.stride_tricks.as_strided(a, (n, 8), (1, 1)).copy().view(np.uint64).ravel()


def gram_hashes(a: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the GRAM bytes from each of the first n places on; a has GRAM + 8 bytes more."""
    x = _words(a, n + GRAM - 8)
    h = np.zeros(n, np.uint64)
    for j in range(0, GRAM, 8):
        h = (h ^ x[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def anchors(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all strings of LENGTH bytes within the documents (starts, ends)."""
    width = REACH + 1
    padded = np.append(text, np.zeros(LENGTH + 16, np.uint8))
    valid = np.zeros(len(text) + 1, np.int8)  # +1 where strings begin to fit, -1 where they cease to
    long = ends - starts >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    places, hashes = [], []
    for at in range(0, len(text), PIECE):
        fits = valid[at : at + PIECE]
        if not fits.any():
            continue
        n = len(fits) + REACH
        h = gram_hashes(padded[at : at + n + GRAM + 8], n)
        least = (h & ~PLACE) | np.arange(n - 1, -1, -1, dtype=np.uint64)  # of equal hashes the rightmost
        step = 1
        while step < width:
            by = min(step, width - step)
            least = np.minimum(least[:-by], least[by:])
            step += by
        own = np.unique(n - 1 - (least[fits] & PLACE).astype(np.int64))
        places.append(own + at)
        hashes.append(h[own])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def suffix_array(s: np.ndarray, prefix: int | None = None, covered: int = 1) -> np.ndarray:
    """Order of the suffixes of s (positive integers) by the difference cover {1, 2} modulo 3; with `prefix`, by as
    many characters of the text at least, where a character of s stands for `covered` of them."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.append(s, np.zeros(4, s.dtype)).astype(np.int64)
    size = int(t.max()) + 1
    extra = n % 3 == 1  # then a triple of zeros ends the first half of the names
    one, two = np.arange(1, n + extra, 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    last = None  # the order of the sample by its triples, where it comes out
    if size < 1 << 20:
        key = (t[sample] * size + t[sample + 1]) * size + t[sample + 2]
        if size**3 <= 1 << 25:  # few possible triples: names by counting them
            there = np.zeros(size**3, bool)
            there[key] = True
            names = np.cumsum(there, dtype=np.int32)[key].astype(np.int64)
        else:
            last = np.argsort(key)
            new = np.append(True, np.diff(key[last]) != 0)
    else:
        last = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        a = sample[last]
        new = np.append(True, (t[a[1:]] != t[a[:-1]]) | (t[a[1:] + 1] != t[a[:-1] + 1]) | (t[a[1:] + 2] != t[a[:-1] + 2]))
    if last is not None:
        names = np.empty(len(sample), np.int64)
        names[last] = np.cumsum(new)
    if names.max() < len(sample) and (prefix is None or 3 * covered < prefix):
        order = suffix_array(names, prefix, 3 * covered)
        names[order] = np.arange(1, len(sample) + 1)
    else:
        order = np.argsort(names) if last is None else last
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    order = order[sample[order] < n]
    sorted12 = sample[order]
    zero = np.arange(0, n, 3)
    base = int(names.max()) + 2
    zero = zero[np.argsort(t[zero] * base + rank[zero + 1])]
    # The merge: how many sampled suffixes stand before each other one, by the comparisons that lead to sampled places.
    is_one = sorted12 % 3 == 1
    s1, s2 = sorted12[is_one], sorted12[~is_one]
    before1 = np.searchsorted(t[s1] * base + rank[s1 + 1], t[zero] * base + rank[zero + 1])
    pairs = lambda i: t[i] * size + t[i + 1]
    if size * size < (1 << 62) // base:
        before2 = np.searchsorted(pairs(s2) * base + rank[s2 + 2], pairs(zero) * base + rank[zero + 2])
    else:
        values = np.concatenate((s2, zero))
        by = np.lexsort((np.append(np.ones(len(s2)), np.zeros(len(zero))), rank[values + 2], t[values + 1], t[values]))
        before2 = np.empty(len(zero), np.int64)
        is_two = by < len(s2)
        before2[by[~is_two] - len(s2)] = np.cumsum(is_two)[~is_two]
    out = np.empty(n, np.int64)
    at = np.maximum.accumulate(before1 + before2) + np.arange(len(zero)) if len(zero) else before1
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = zero, sorted12
    return out


def earlier(records: np.ndarray, lens: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each record (bytes end to end) a mask of its strings of LENGTH bytes that also stand in a record of a
    smaller document."""
    if not len(lens):
        return np.zeros(0, np.uint32)
    ends = np.cumsum(lens)
    n = int(ends[-1]) + len(lens)
    of = np.repeat(np.arange(len(lens)), lens)
    text = np.ones(n, np.int64)  # a separator after each record
    text[np.arange(len(records)) + of] = records.astype(np.int64) + 2
    starts = ends - lens + np.arange(len(lens))
    order = suffix_array(text, LENGTH)
    of = np.repeat(np.arange(len(lens)), lens + 1)
    order = order[order - starts[of[order]] <= (lens - LENGTH)[of[order]]]  # strings within a record
    if not len(order):
        return np.zeros(len(lens), np.uint32)
    raw = np.append(np.minimum(text - 1, 255), np.zeros(LENGTH + 16, np.int64)).astype(np.uint8)
    # Neighbours of equal prefixes. A separator is 0 here, and no string holds one.
    raw[: n][text > 1] = (text[text > 1] - 2).astype(np.uint8)
    words = _words(raw, n + LENGTH)
    new = np.ones(len(order), bool)
    same = np.ones(len(order) - 1, bool)
    for at in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        w = words[order + at]
        same &= w[1:] == w[:-1]
    new[1:] = ~same
    doc = docs[of[order]]
    least = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = order[doc > least]
    return np.bincount(of[hit], weights=2.0 ** (hit - starts[of[hit]]), minlength=len(lens)).astype(np.uint32)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Blocks of documents; `whole` ones have the other columns, too, and whether the text was null, as an Arrow stream."""
    others = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    rest = F.struct(*others, docs[f"`{text_col}`"].isNull().alias("none"))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        text = rows.column("text").to_pylist()
        row = [uuid.uuid4().hex, rows.column("id").to_pylist(), [len(t) for t in text], b"".join(text)]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        if whole:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, (kept := rows.select(["rest"])).schema) as stream:
                stream.write_table(kept)
            row.append(out.getvalue().to_pybytes())
            kinds.append(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["block", "doc_id", "lens", "text", "rest"][: len(row)])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += sum(map(len, batch.column(1).to_pylist()))
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if n or sum(b.num_rows for b in held):
            yield block(held)

    common.small_batches(docs.sparkSession)
    text = F.coalesce(docs[f"`{text_col}`"], F.lit("")).cast("binary")
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), text.alias("text"), *([rest.alias("rest")] if whole else []))
    return rows.mapInArrow(run, BLOCKS + (", rest binary" if whole else ""))


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)


def _dealt(block: str, part: np.ndarray, columns: list[tuple[np.ndarray, np.ndarray | None]]) -> pa.RecordBatch:
    """A row for each part that has entries, with the bytes of each column's own ones, in order. A column may be
    ragged: (flat, lens)."""
    by = np.argsort(part, kind="stable")
    own, first = np.unique(part[by], return_index=True)
    cuts = np.append(first, len(part))
    out = []
    for flat, lens in columns:
        if lens is None:
            v, at = flat[by], cuts
        else:
            v, at = common.ragged(flat, (np.cumsum(lens) - lens)[by], lens[by]), np.append(0, np.cumsum(lens[by]))[cuts]
        out.append(pa.array([v[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([block] * len(own), pa.string()), *out], ["part", "block", *"abcd"[: len(out)]])


def _gathered(got: list | None, part: np.ndarray, dtype) -> np.ndarray:
    """What the parts sent back, in the order of the entries."""
    out = np.zeros(len(part), dtype)
    by = np.argsort(part, kind="stable")
    if got:
        out[by] = np.concatenate([np.frombuffer(x["data"], dtype) for x in sorted(got, key=lambda x: x["part"])])
    return out


def distinct(flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of byte strings that stand end to end: the place of the first of each distinct one, and for each which it is."""
    ends = np.append(0, np.cumsum(lens)).astype(np.int64)
    strings = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])
    which = strings.dictionary_encode().indices.to_numpy()
    n = int(which.max(initial=-1)) + 1
    first = np.empty(n, np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    return first, which


class Block:
    """A block's anchors, and what is known of them."""

    def __init__(self, row: dict, parts: int):
        self.row, self.parts = row, parts
        self.text = np.frombuffer(row["text"], np.uint8)
        self.lens = np.array(row["lens"], np.int64)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        known = np.array([i is not None for i in row["doc_id"]], bool)
        self.ids = np.array([i or 0 for i in row["doc_id"]], np.int64)
        if "at" in row:  # share() was there before
            self.at, self.hash, hot = (np.frombuffer(row[c], k) for c, k in (("at", "<i8"), ("hash", np.uint64), ("hot", np.uint8)))
            self.hot = hot > 0
        elif "r0" in row:
            known &= ~self.copies()
            self.at, self.hash = anchors(self.text, self.starts[known], self.ends[known])

    def copies(self) -> np.ndarray:
        """Which documents are copies of documents with smaller ids."""
        out = np.zeros(len(self.lens), bool)
        for answer in self.row["r0"] or []:
            out[np.frombuffer(answer["data"], np.int32)] = True
        return out

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """The documents with ids and LENGTH bytes at least, and the SHA-256 of each, as rows of four words."""
        own = np.array([i for i, (d, n) in enumerate(zip(self.row["doc_id"], self.lens)) if d is not None and n >= LENGTH], np.int64)
        text = memoryview(self.row["text"])
        found = b"".join(hashlib.sha256(text[self.starts[i] : self.ends[i]]).digest() for i in own)
        return own, np.frombuffer(found, np.uint64).reshape(len(own), 4)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct anchors, which of them each place has, how often they occur, and whether documents of this block
        share them."""
        keys, which, n = np.unique(self.hash, return_inverse=True, return_counts=True)
        doc = self.ids[self.doc(self.at)]
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, which, doc)
        np.maximum.at(high, which, doc)
        return keys, which, n, low < high

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def share(self) -> list[bytes]:
        """The anchors that documents share: places, hashes, and whether they are hot."""
        keys, which, _, _ = self.keys()
        answer = _gathered(self.row["r1"], _part(keys, self.parts), np.uint8)[which]
        keep = answer > 0
        return [self.at[keep].astype("<i8").tobytes(), self.hash[keep].tobytes(), (answer[keep] > 1).astype(np.uint8).tobytes()]

    def contexts(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some anchors: the document's id, and where the context begins and how long it is."""
        at = self.at[own]
        doc = self.doc(at)
        low = np.maximum(self.starts[doc], at - REACH)
        return self.ids[doc], low, np.minimum(self.ends[doc], at + LENGTH) - low

    def follow(self) -> None:
        """Puts equal contexts of equal anchors together, as entries with their least documents."""
        (self.of, self.low, self.size), hash_ = self.contexts(~self.hot), self.hash[~self.hot]
        _, which = distinct(common.ragged(self.text, self.low, self.size), self.size)
        by = np.lexsort((which, hash_))
        new = np.append(True, (np.diff(which[by]) != 0) | (hash_[by][1:] != hash_[by][:-1]))[: len(by)]
        self.entry = np.empty(len(by), np.int64)
        self.entry[by] = np.cumsum(new) - 1
        self.first = by[new]
        self.least = np.full(len(self.first), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.entry, self.of)
        self.entry_hash = hash_[self.first]
        self.entry_part = _part(self.entry_hash, self.parts)

    def follow_hot(self) -> None:
        """Likewise the distinct strings of hot anchors."""
        of, low, size = self.contexts(self.hot)
        strings = np.maximum(size - LENGTH + 1, 0)
        self.hot_low = np.repeat(low, strings) + np.arange(int(strings.sum())) - np.repeat(np.cumsum(strings) - strings, strings)
        self.hot_of = np.repeat(of, strings)
        self.hot_low, unique = np.unique(self.hot_low, return_index=True)
        self.hot_of = self.hot_of[unique]
        self.hot_first, self.hot_which = self.distinct_strings(self.hot_low)
        self.hot_least = np.full(len(self.hot_first), np.iinfo(np.int64).max)
        np.minimum.at(self.hot_least, self.hot_which, self.hot_of)

    def distinct_strings(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """distinct() of strings of LENGTH bytes, in pieces, as their bytes would be 50 times the text."""
        first, which = np.zeros(0, np.int64), np.zeros(len(low), np.int64)
        for at in range(0, len(low), PIECE):
            part = low[at : at + PIECE]
            both = np.append(low[first], part)
            f, w = distinct(common.ragged(self.text, both, np.full(len(both), LENGTH)), np.full(len(both), LENGTH))
            which[at : at + PIECE] = w[len(first) :]
            first = np.append(first, f[len(first) :] - len(first) + at)
        return first, which

    def removed(self) -> np.ndarray:
        """Whether each byte goes."""
        self.follow()
        self.follow_hot()
        masks = _gathered(self.row["r2"], self.entry_part, np.uint32)[self.entry]
        cover = np.zeros(len(self.text) + 1, np.int32)

        def add(low, size):
            np.add.at(cover, low, 1)
            np.add.at(cover, low + size, -1)

        whole = self.of > self.least[self.entry]
        add(self.low[whole], self.size[whole])
        for bit in range(REACH + 1):
            own = ~whole & ((masks >> np.uint32(bit) & 1) > 0) & (bit + LENGTH <= self.size)
            add(self.low[own] + bit, LENGTH)
        earlier_ = np.zeros(len(self.hot_first), bool)
        earlier_[self.row["r3"] or []] = True
        gone = earlier_[self.hot_which] | (self.hot_of > self.hot_least[self.hot_which])
        add(self.hot_low[gone], LENGTH)
        copies = self.copies()
        add(self.starts[copies], self.lens[copies])
        return np.cumsum(cover[:-1], dtype=np.int32) > 0


def _arrays(pdf: pd.DataFrame, column: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    own = [np.frombuffer(x, dtype) for x in pdf[column]]
    return np.concatenate(own), np.cumsum([len(x) for x in own])[:-1]


def _back(pdf: pd.DataFrame, values: np.ndarray, cuts: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"part": pdf["part"], "block": pdf["block"], "data": [x.tobytes() for x in np.split(values, cuts)]})


def _shared(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    """Which anchors two documents share, in one block or as two blocks have them: 1, or 2 if they occur
    more than `most` times. Hashes are cut
    to 32 bits here, so some are followed in vain."""
    keys, cuts = _arrays(pdf, "a", np.uint32)
    n, _ = _arrays(pdf, "b", np.uint16)
    within, _ = _arrays(pdf, "c", np.uint8)
    _, which, blocks = np.unique(keys, return_inverse=True, return_counts=True)
    hot = np.bincount(which, weights=n) > most
    two = np.bincount(which, weights=within) + (blocks > 1) > 0
    return _back(pdf, (two.astype(np.uint8) + (two & hot))[which].astype(np.uint8), cuts)


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Marks the strings of each record that smaller documents have: of equal records that of the least document is
    sorted with the others, unless its anchor has no other contexts."""
    flat, _ = _arrays(pdf, "a", np.uint8)
    lens, cuts = _arrays(pdf, "b", np.uint8)
    lens = lens.astype(np.int64)
    doc, _ = _arrays(pdf, "c", np.int64)
    anchor, _ = _arrays(pdf, "d", np.uint32)
    first, which = distinct(flat, lens)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    _, group, n = np.unique(anchor[first], return_inverse=True, return_counts=True)
    several = n[group] > 1
    masks = np.zeros(len(first), np.uint32)
    starts, own = (np.cumsum(lens) - lens)[first[several]], lens[first[several]]
    masks[several] = earlier(common.ragged(flat, starts, own), own, least[several])
    return _back(pdf, np.where(doc > least[which], np.uint32(0xFFFFFFFF >> (31 - REACH)), masks[which]).astype(np.uint32), cuts)


def _round(known: DataFrame, name: str, buckets: int, parts: int, k: int, ask, answer, columns: str) -> DataFrame:
    """One exchange: blocks ask the parts, whose answers are stored in the blocks' buckets and joined to them as r<k>."""
    spark = known.sparkSession

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield ask(Block(row, parts))

    common.small_batches(spark)
    asked = known.mapInArrow(run, "part int, block string, " + ", ".join(f"{c} binary" for c in columns))
    answers = asked.groupBy("part").applyInPandas(answer, "part int, block string, data binary")
    own = answers.groupBy("block").agg(F.collect_list(F.struct("part", "data")).alias(f"r{k}"))
    return known.join(_put(own, f"{name}_{k}", buckets), "block", "left")


def _ask_shared(b: Block) -> pa.RecordBatch:
    keys, _, n, within = b.keys()
    return _dealt(b.row["block"], _part(keys, b.parts), [((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), None), (np.minimum(n, 0xFFFF).astype(np.uint16), None), (within.astype(np.uint8), None)])


def _ask_copies(b: Block) -> pa.RecordBatch:
    own, digests = b.digests()
    four = np.full(len(own), 4)
    return _dealt(b.row["block"], _part(digests[:, 0], b.parts), [(digests.ravel(), four), (b.ids[own], None), (own.astype(np.int32), None)])


def _copied(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each block the documents whose text a smaller document has."""
    digests, _ = _arrays(pdf, "a", np.uint64)
    doc, cuts = _arrays(pdf, "b", np.int64)
    place, _ = _arrays(pdf, "c", np.int32)
    _, which = np.unique(digests.view(np.dtype((np.void, 32))), return_inverse=True)
    least = np.full(len(doc), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    copy = doc > least[which]
    return pd.DataFrame({"part": pdf["part"], "block": pdf["block"], "data": [p[c].tobytes() for p, c in zip(np.split(place, cuts), np.split(copy, cuts))]})


def _ask_sorted(b: Block) -> pa.RecordBatch:
    b.follow()
    low, size = b.low[b.first], b.size[b.first]
    short = (b.entry_hash & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return _dealt(b.row["block"], b.entry_part, [(common.ragged(b.text, low, size), size), (size.astype(np.uint8), None), (b.least, None), (short, None)])


def _put(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """Stores df bucketed by block, as a table in the shared folder."""
    common.put_table(df, name, buckets, "block")
    return df.sparkSession.table(name)


def _shared_anchors(known: DataFrame, name: str, buckets: int, parts: int) -> DataFrame:
    """Stores the shared anchors of each block in its bucket."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                columns = [row["block"], *Block(row, parts).share()]
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], ["block", "at", "hash", "hot"])

    return _put(known.mapInArrow(run, "block string, at binary, hash binary, hot binary"), f"{name}_shared", buckets)


def _hot_strings(known: DataFrame, name: str, buckets: int, parts: int) -> DataFrame:
    """Stores for each block which of its hot strings smaller documents of other blocks have. A block gives a string
    once, the least document is a partial sum, and a frequent string's rows can be dealt anew by the skewed join."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, parts)
                b.follow_hot()
                low = b.hot_low[b.hot_first]
                for at in range(0, len(low), ROWS):
                    part = low[at : at + ROWS]
                    strings = pa.array([row["text"][a : a + LENGTH] for a in part.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(part), pa.string()), pa.array(range(at, at + len(part)), pa.int32()), strings, pa.array(b.hot_least[at : at + ROWS])], ["block", "i", "s", "doc"])

    hot = known.mapInArrow(run, "block string, i int, s binary, doc long")
    least = hot.groupBy("s").agg(F.min("doc").alias("least"))
    found = hot.join(least, "s").where("doc > least").groupBy("block").agg(F.collect_list("i").alias("r3"))
    return _put(found, f"{name}_hot", buckets)


def _marked(docs: DataFrame, id_col: str, text_col: str, whole: bool = False) -> tuple[DataFrame, int]:
    """The blocks with all that is known of their anchors, and the number of parts."""
    spark = docs.sparkSession
    name = f"vexel_suffix_{uuid.uuid4().hex}"
    buckets = 2 * common.parts(spark)
    stored = _put(pack(docs, id_col, text_col, whole), name, buckets)
    blocks = stored.drop("rest")
    size = blocks.select(F.sum(F.length("text"))).first()[0] or 0
    parts = int(max(buckets, size >> 22))
    most = HOT
    first = _round(blocks, name, buckets, parts, 0, _ask_copies, _copied, "abc")
    shared = _shared_anchors(_round(first, name, buckets, parts, 1, _ask_shared, lambda pdf: _shared(pdf, most), "abc"), name, buckets, parts)
    followed = blocks.join(shared, "block")
    hot = _hot_strings(followed, name, buckets, parts)
    masks = _round(followed, name, buckets, parts, 2, _ask_sorted, _sorted, "abcd").select("block", "r2")
    copies = first.select("block", "r0")
    return stored.join(shared, "block").join(masks, "block", "left").join(hot, "block", "left").join(copies, "block", "left"), parts


def _documents(known: DataFrame, parts: int, schema, result) -> DataFrame:
    """result(block, removed) makes the rows of a block's documents."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, parts)
                yield result(b, b.removed())

    common.small_batches(known.sparkSession)
    return known.mapInArrow(run, schema)


def _kept(text: bytes, removed: np.ndarray, a: int, b: int) -> bytes:
    own = removed[a:b]
    return np.frombuffer(text, np.uint8)[a:b][~own].tobytes() if own.any() else text[a:b]


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id; strings are
    judged on the input and don't cross documents. Null text counts as empty. Rows of equal ids remove nothing from
    one another; rows without an id are left as they are and remove nothing. Other columns are ignored.
    """

    def result(block: Block, removed: np.ndarray) -> pa.RecordBatch:
        text, spans_of = block.row["text"], list(zip(block.starts.tolist(), block.ends.tolist()))
        n = [int(removed[a:b].sum()) for a, b in spans_of]
        spans = [int((np.diff(removed[a:b].view(np.int8), prepend=0) == 1).sum()) if k else 0 for k, (a, b) in zip(n, spans_of)]
        kept = [hashlib.sha256(_kept(text, removed, a, b)).hexdigest() for a, b in spans_of]
        columns = [pa.array(block.row["doc_id"], pa.int64()), pa.array(block.lens), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    known, parts = _marked(docs, id_col, text_col)
    return _documents(known, parts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", result)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes taken out of their texts; what is left of a character that was cut goes, too.

    Each row travels with its block and comes out once, with all its columns as they were, whatever its id: nothing is
    joined back. Null texts stay null.
    """
    names = docs.columns

    def result(block: Block, removed: np.ndarray) -> pa.RecordBatch:
        rest = pa.ipc.open_stream(block.row["rest"]).read_all().combine_chunks().column("rest").chunk(0)
        none = rest.field("none").to_pylist()
        texts = [None if x else _kept(block.row["text"], removed, a, b).decode("utf-8", "ignore") for x, a, b in zip(none, block.starts.tolist(), block.ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else rest.field(f"c{i}") for i, c in enumerate(names)], names)

    known, parts = _marked(docs, id_col, text_col, whole=True)
    return _documents(known, parts, docs.schema, result)
