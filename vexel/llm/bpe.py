"""Byte-level BPE by a pair occurrence index.

A partition's texts are cut into pretokens; the distinct new ones are laid out in one symbol array. The index maps
each mergeable pair to all its positions there. Active ranks are applied in ascending order, each to its whole list
at once; the pairs that a merge makes go into the lists of their own (always higher) ranks.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import common

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for `re`, which is faster; it agrees on texts without the characters of UNUSUAL.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNUSUAL = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞€]")
FULL = regex.compile(PATTERN)
#: White space that stands at an end of the text or next to other white space.
UNEVEN = re.compile(r"\s\s|^\s|\s\Z")

BUFFER = 8 << 20  # bytes of text handled at once
CACHE = 500_000  # pieces kept by a worker before it drops those it met once


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merge table and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_chars()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(chars[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = np.array([vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.size = size
        keys = self.left.astype(np.int64) * size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        lens = np.array([len(b) for b in self.bytes], np.int64)
        self.flat, self.lens, self.starts = np.frombuffer(b"".join(self.bytes), np.uint8), lens, np.cumsum(lens) - lens
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where there is none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def decode(self, ids: np.ndarray) -> str:
        return common.ragged(self.flat, self.starts[ids], self.lens[ids]).tobytes().decode("utf-8", "replace")

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many ids each has. No word is empty."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lens = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lens)
        n = int(ends[-1])
        sym = np.append(self.byte_id[np.frombuffer(b"".join(words), np.uint8)], np.int32(-1))
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[ends - 1], prv[ends - lens] = n, -1  # position n: no neighbour
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(pos: np.ndarray) -> None:
            pos = pos[nxt[pos] < n]
            rank = self.ranks(sym[pos], sym[nxt[pos]])
            pos, rank = pos[rank >= 0], rank[rank >= 0]
            if not len(pos):
                return
            by = np.argsort(rank, kind="stable")
            pos, rank = pos[by], rank[by]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, p in zip(rank[np.append(0, cut)].tolist(), np.split(pos, cut)):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(active, r)

        enter(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            p = lists[0] if len(lists) == 1 else np.sort(np.concatenate(lists))
            a, b = self.left[rank], self.right[rank]
            p = p[(sym[p] == a) & (sym[nxt[p]] == b)]
            if a == b and len(p) > 1:  # in a run of equal symbols the leftmost pairs go first
                start = np.append(True, nxt[p[:-1]] != p[1:])
                first = np.flatnonzero(start)
                p = p[(np.arange(len(p)) - first[np.cumsum(start) - 1]) % 2 == 0]
            if not len(p):
                continue
            q = nxt[p]
            sym[p], sym[q] = self.made[rank], -1
            after = nxt[q]
            nxt[p] = after
            prv[after] = p
            before = prv[p]
            new = before >= 0
            new[1:] &= before[1:] != p[:-1]  # those are entered as p
            enter(np.concatenate((before[new], p)))
        alive = sym[:n] >= 0
        return sym[:n][alive], np.add.reduceat(alive, ends - lens, dtype=np.int64)


def pretokens(text: str) -> list[str]:
    return (FULL if UNUSUAL.search(text) else PLAIN).findall(text)


class Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Encoder:
    """Encodes texts. Remembers the ids of the pieces and pretokens it met; beyond CACHE pieces only those met again.

    A text whose white space is single characters between words is cut at its spaces into pieces, and each distinct
    piece is cut into pretokens once: with its leading space it has the same pretokens wherever it stands. Other
    texts are cut whole. `encode` maps a list of new pretokens to their ids, end to end, and the ids of each.
    """

    def __init__(self, special: dict[str, int], split, encode):
        self.special, self.split, self.encode = special, split, encode
        self.clear()

    def clear(self) -> None:
        self.pieces, self.words = Numbers(), Numbers()
        self.piece_ids, self.piece_lens = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.word_ids, self.word_lens = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)  # of each piece, since the last trim()

    def trim(self) -> None:
        """Forgets the pretokens, and the pieces met only once; of the others, at most CACHE / 2 stay, the most used."""
        keep = np.flatnonzero(self.uses > 1)
        keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: CACHE // 2]])
        names, starts, lens = list(self.pieces), np.cumsum(self.piece_lens) - self.piece_lens, self.piece_lens[keep]
        ids = common.ragged(self.piece_ids, starts[keep], lens)
        self.clear()
        self.pieces = Numbers({names[i]: n for n, i in enumerate(keep.tolist())})
        self.piece_ids, self.piece_lens, self.uses = ids, lens, np.zeros(len(keep), np.int64)

    def uneven(self, text: str) -> list | None:
        """The keys of a text that can't be cut at its spaces: a tuple stands for just its text."""
        if self.split is not None and any(s in text for s in self.special):
            return [(w,) for part in self.split.split(text) for w in ([part] if part in self.special else pretokens(part))]
        plain = text.replace("\n", " ")  # of white space, only the space is printable
        if plain.isprintable() and plain and plain[0] != " " != plain[-1] and "  " not in plain:
            return None
        return [(w,) for w in pretokens(text)] if not text or UNEVEN.search(text) else None

    def numbered(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's pieces. Arrow cuts the texts and finds the distinct pieces, of which a string
        stands for itself after a space."""
        number = self.pieces.__getitem__
        out: list = [self.uneven(t) for t in texts]
        out = [k if k is None else np.fromiter(map(number, k), np.int32, len(k)) for k in out]
        even = [i for i, k in enumerate(out) if k is None]
        lists = pc.split_pattern(pa.array([texts[i] for i in even], pa.large_string()), " ")
        values, ends = lists.values.dictionary_encode(), lists.offsets.to_numpy()
        distinct = values.dictionary.to_pylist()
        seq = np.fromiter(map(number, distinct), np.int32, len(distinct))[values.indices.to_numpy()]
        first = values.indices.to_numpy()[ends[:-1]].tolist()
        seq[ends[:-1]] = [number((distinct[f],)) for f in first]  # no space stands before them
        for i, a, b in zip(even, ends.tolist(), ends[1:].tolist()):
            out[i] = seq[a:b]
        return out

    def learn(self, new: list) -> None:
        """Finds the ids of new pieces, by way of those of new pretokens."""
        find = PLAIN.findall if all(UNUSUAL.search("".join(map("".join, new[i : i + 10_000]))) is None for i in range(0, len(new), 10_000)) else pretokens
        # A piece of letters only is one pretoken with its space.
        cut = [([k[0]] if k[0] in self.special else find(k[0])) if type(k) is tuple else [" " + k] if k.isalpha() else find(" " + k) for k in new]
        known, number = len(self.words), self.words.__getitem__
        counts = np.array([len(c) for c in cut], np.int64)
        seq = np.fromiter(map(number, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        words = list(self.words)[known:]
        special = [(i, w) for i, w in enumerate(words) if w in self.special]
        ids, lens = self.encode([w for w in words if w not in self.special] if special else words)
        for i, w in special:
            at = int(lens[:i].sum())
            ids, lens = np.insert(ids, at, self.special[w]), np.insert(lens, i, 1)
        self.word_ids, self.word_lens = np.concatenate((self.word_ids, ids)), np.concatenate((self.word_lens, lens))
        per = self.word_lens[seq]
        starts = np.cumsum(self.word_lens) - self.word_lens
        self.piece_ids = np.concatenate((self.piece_ids, common.ragged(self.word_ids, starts[seq], per)))
        ends = np.append(0, np.cumsum(per))[np.append(0, np.cumsum(counts))]
        self.piece_lens = np.concatenate((self.piece_lens, np.diff(ends)))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each text has."""
        collects = gc.isenabled()
        gc.disable()  # many small lists and no cycles
        try:
            return self._texts(texts)
        finally:
            if collects:
                gc.enable()

    def _texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pieces) > CACHE:
            self.trim()
        known, seqs = len(self.pieces), self.numbered(texts)
        if len(self.pieces) > known:
            self.learn(list(self.pieces)[known:])
        seq = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
        uses = np.bincount(seq, minlength=len(self.pieces))
        uses[:known] += self.uses
        self.uses = uses
        starts, per = np.cumsum(self.piece_lens) - self.piece_lens, self.piece_lens[seq]
        ends = np.append(0, np.cumsum(per))
        bounds = np.cumsum([0] + [len(s) for s in seqs])
        return common.ragged(self.piece_ids, starts[seq], per), np.diff(ends[bounds])


_encoders: dict[str, tuple[Vocabulary, Encoder]] = {}


def loaded(path: str) -> tuple[Vocabulary, Encoder]:
    """One vocabulary and encoder for each Python worker."""
    if path not in _encoders:
        v = Vocabulary(path)
        _encoders[path] = v, Encoder(v.special, v.split, lambda words: v.encode([w.encode() for w in words]))
    return _encoders[path]


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: doc_id, ids (array<int>), decoded (string).

    Null texts count as empty and have no ids. Repeated rows give repeated results; null ids stay null. Other columns
    are ignored. Special tokens found in a text become their own ids. Texts are handled in buffers of BUFFER bytes.
    """

    def run(batches):
        vocabulary, encoder = loaded(tokenizer)
        for held in common.buffered(batches, BUFFER):
            ids, lens = encoder.texts(held["text"])
            ends = np.cumsum(lens)
            offsets = np.append(0, ends)
            text = [vocabulary.decode(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(held["id"], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(text, pa.string())],
                ["doc_id", "ids", "decoded"],
            )
        encoder.clear()  # the worker may serve other stages next

    common.small_batches(docs.sparkSession)
    return common.keyed(docs, id_col, text_col, binary=False).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encoded() gives, hashed where the ids are made."""

    def run(batches):
        vocabulary, encoder = loaded(tokenizer)
        for held in common.buffered(batches, BUFFER):
            ids, lens = encoder.texts(held["text"])
            ends = np.append(0, np.cumsum(lens)).tolist()
            ids_hash, text_hash = [], []
            for a, b in zip(ends, ends[1:]):
                ids_hash.append(hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(vocabulary.decode(ids[a:b]).encode()).hexdigest())
            columns = [pa.array(held["id"], pa.int64()), pa.array(lens, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        encoder.clear()

    common.small_batches(docs.sparkSession)
    return common.keyed(docs, id_col, text_col, binary=False).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
