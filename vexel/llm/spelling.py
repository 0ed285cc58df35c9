"""Spelling variants: words one edit apart, by forward and reversed sorted dictionaries.

One inserted, deleted or replaced code point leaves one half of a word intact. Of two near words the longer one has m
code points; let d be the first place where they differ. If d is in the last half, they share the first half of m code
points, and stand in one block of a dictionary sorted by words; if not, they share the last half, and stand in one block
of a dictionary sorted by reversed words. A block is a span a <= d < b of such places: its words share the first a and
the last m - b code points. Each dictionary is dealt and sorted by ranges, and a task scans its blocks.

A block that is too large is subdivided by halving its span, again by what is shared before or behind the middle, down
to spans of one place, whose words all differ in that place alone. A pair belongs to the one block that spans its d, so
it is found once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters of a run, as a character class: A-Z, a-z and U+00C0 to U+00FF. All are one byte in Latin-1.
LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
TYPO = 31  # runs whose hash it divides lose a code point
LARGE = 4 << 20  # code points of a block that one task takes
CHUNK = 8 << 20  # code points of the blocks that are scanned at once
SMALL = 24  # words of a block that are compared with each other
BASE = np.uint64(0x9E3779B97F4A7C15)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _without(word: Column, place: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, often: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least `least` code points that occur `often` times in whole texts.

    Words are the maximal runs of LETTERS, A-Z in lower case; a run loses the code point at h modulo its length if 31
    divides h, the crc32 of `<id>:<run>`. Null texts have no words; a null id counts as an empty text. Repeated rows
    count each time; other columns are ignored.
    """
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Shorter runs give shorter words only.
    runs = F.regexp_extract_all(lower, F.lit(f"({LETTERS}{{{least},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    word = F.when(F.col("h") % TYPO == 0, _without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _shared() -> Column:
    """What the words of a block share: the first a, and the last m - b code points from the end on."""
    word, behind = F.col("word"), F.col("m") - F.col("b")
    return F.concat(F.substring(word, F.lit(1), F.col("a")), F.substring(F.reverse(word), F.lit(1), behind))


def _dictionaries(words: DataFrame) -> DataFrame:
    """(word, n, m, a, b, shared): each word in its blocks of both dictionaries, with itself as the longer word of a pair
    (m its length) and as the shorter one."""
    m = F.explode(F.array(F.length("word"), F.length("word") + 1))
    half = F.floor(F.col("m") / 2).cast("int")
    spans = F.explode(F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), F.col("m").alias("b"))))
    rows = words.select("word", "n", m.alias("m")).select("*", spans.alias("s")).select("word", "n", "m", "s.a", "s.b")
    return rows.where("a < b").withColumn("shared", _shared())


BLOCK = ["m", "a", "b", "shared"]


def _large(rows: DataFrame, large: int) -> DataFrame:
    """The blocks that hold more than `large` code points and whose span can be halved."""
    return rows.groupBy(*BLOCK).agg(F.sum(F.col("m").cast("long")).alias("size")).where((F.col("size") > large) & (F.col("b") - F.col("a") > 1)).drop("size")


def _halved(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    spans = F.explode(F.array(F.struct("a", mid.alias("b")), F.struct(mid.alias("a"), "b")))
    return rows.select("word", "n", "m", spans.alias("s")).select("word", "n", "m", "s.a", "s.b").withColumn("shared", _shared())


def _blocks(words: DataFrame, large: int) -> list[DataFrame]:
    """Entries of all blocks; those that were too large are replaced by their halves."""
    now, done = _dictionaries(words), []
    while True:
        big = common.stored(_large(now, large))
        if big.isEmpty():
            return [*done, now]
        done.append(now.join(big, BLOCK, "left_anti"))
        now = common.stored(_halved(now.join(big, BLOCK, "left_semi")))


def _aligned(words: list[bytes], m: int) -> tuple[np.ndarray, np.ndarray]:
    """The words (m or m - 1 bytes) as rows of m bytes, from the left and from the right."""
    left = np.frombuffer(b"".join(w.ljust(m, b"\0") for w in words), np.uint8).reshape(-1, m)
    right = np.frombuffer(b"".join(w.rjust(m, b"\0") for w in words), np.uint8).reshape(-1, m)
    return left, right


def _running(rows: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... m bytes of each row."""
    out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    for i in range(rows.shape[1]):
        out[:, i + 1] = (out[:, i] + rows[:, i] + np.uint64(1)) * BASE
        out[:, i + 1] ^= out[:, i + 1] >> np.uint64(29)
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, where each run of equal ones starts, and the end."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.append(np.flatnonzero(new), len(new))


def near_pairs(words: list[bytes], m: int, a: int, b: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in `words` of the pairs of a block one edit apart, the longer word of m bytes, whose first
    difference is in the span a <= d < b. `block` numbers the blocks; large ones are subdivided."""
    left, right = _aligned(words, m)
    sizes = np.array([len(w) for w in words])
    before, behind = _running(left), _running(right[:, ::-1])
    at = np.arange(len(words))
    lo, hi = np.full(len(words), a), np.full(len(words), b)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):
        order = np.argsort(block, kind="stable")
        at, lo, hi, block = at[order], lo[order], hi[order], block[order]
        edge = _runs(block)
        size = np.diff(edge)
        some = np.maximum.reduceat(sizes[at], edge[:-1]) == m  # with a word of m bytes
        small = (size <= SMALL) | (hi[edge[:-1]] - lo[edge[:-1]] == 1)
        found += _compared(left, right, sizes, m, at, lo, hi, edge, np.repeat(small & some & (size > 1), size))
        rest = np.repeat(~small & some, size)
        at, lo, hi, block = at[rest], lo[rest], hi[rest], block[rest]
        if not len(at):
            break
        mid = (lo + hi) // 2
        key = np.concatenate((behind[at, m - mid], before[at, mid]))
        at, side = np.concatenate((at, at)), np.repeat([0, 1], len(at))
        lo, hi, block = np.concatenate((lo, mid)), np.concatenate((mid, hi)), np.concatenate((block, block))
        order = np.lexsort((key, side, block))
        edge = _runs(block[order], side[order], key[order])
        new = np.empty(len(at), np.int64)
        new[order] = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        block = new
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _compared(left, right, sizes, m, at, lo, hi, edge, use) -> list[tuple[np.ndarray, np.ndarray]]:
    """The near pairs within blocks, by comparing each word with the next, the one after it, and so on."""
    end = np.repeat(edge[1:], np.diff(edge))
    places, step, found = np.flatnonzero(use), 1, []
    while True:
        places = places[places + step < end[places]]
        if not len(places):
            return found
        for part in np.array_split(places, max(1, len(places) * m // CHUNK)):
            i, j = at[part], at[part + step]
            swap = sizes[i] < sizes[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            long = sizes[i] == m
            i, j, where = i[long], j[long], part[long]
            other = left[i] != left[j]
            d = np.where(other.any(1), other.argmax(1), m - 1)
            # Behind d, both agree counted from the right.
            tail = right[i] != right[j]
            tail &= np.arange(m)[None, :] > d[:, None]
            good = other[np.arange(len(i)), d] & ~tail.any(1) & (d >= lo[where]) & (d < hi[where])
            found.append((i[good], j[good]))
        step += 1


SCAN = "word string, n_near long, best_n long, best string"


def _scan(batches):
    """Near words of sorted entries: a row (word, n_near, best_n, best) for each word and block span with any."""
    held: dict[str, list] = {}

    def result(group: dict[str, list]):
        words = [w.encode("latin-1") for w in group["word"]]
        counts = np.array(group["n"], np.int64)
        keys = list(zip(group["m"], group["a"], group["b"], group["shared"]))
        edge = np.array([0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)])
        block = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        spans = [0, *[k for k in range(1, len(keys)) if keys[k][:3] != keys[k - 1][:3]], len(keys)]
        pairs = []
        for s, e in zip(spans, spans[1:]):
            m, a, b, _ = keys[s]
            i, j = near_pairs(words[s:e], m, a, b, block[s:e])
            pairs.append((i + s, j + s))
        i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        i, j = np.concatenate((i, j)), np.concatenate((j, i))
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[j], -counts[j], i))
        i, j = i[order], j[order]
        first = _runs(i) if len(i) else np.zeros(1, np.int64)
        at, best = i[first[:-1]], j[first[:-1]]
        take = group["word"].__getitem__
        return pa.RecordBatch.from_arrays([pa.array(map(take, at), pa.string()), pa.array(np.diff(first), pa.int64()), pa.array(counts[best], pa.int64()), pa.array(map(take, best), pa.string())], ["word", "n_near", "best_n", "best"])

    for batch in batches:
        new = batch.to_pydict()
        for name, values in new.items():
            held.setdefault(name, []).extend(values)
        if not held["word"] or sum(held["m"]) < CHUNK:
            continue
        last = tuple(held[c][-1] for c in BLOCK)  # its block may go on
        cut = len(held["word"])
        while cut and tuple(held[c][cut - 1] for c in BLOCK) == last:
            cut -= 1
        if cut:
            yield result({name: values[:cut] for name, values in held.items()})
            held = {name: values[cut:] for name, values in held.items()}
    if held and held["word"]:
        yield result(held)


def near_words(words: DataFrame, large: int = LARGE) -> DataFrame:
    """(word, n_near, best_n, best) for each of the distinct `words` (word, n) that has words one edit apart: how many
    they are, and the one that occurs most, of equal ones the smallest in code-point order."""
    n = common.parts(words.sparkSession)
    found = None
    for rows in _blocks(words, large):
        # The sorted dictionaries: ranges of spans and of what is shared, scanned in order.
        part = rows.repartitionByRange(n, *BLOCK).sortWithinPartitions(*BLOCK, "word").mapInArrow(_scan, SCAN)
        found = part if found is None else found.unionByName(part)
    best = F.min(F.struct((-F.col("best_n")).alias("down"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.down")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each row (word, form), following forms to the last. Steps are doubled: as a form occurs FACTOR
    times as often as its word, a chain has fewer than 20, and 5 rounds do. A form has few words, all one edit from it,
    so no key is hot."""
    now = common.stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("on"))
        both = common.stored(now.join(ahead, "root", "left").select("word", "root", "on"))
        if both.where("on is not null").isEmpty():
            return both.select("word", "root")
        now = both.select("word", F.coalesce("on", "root").alias("root"))


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each of the distinct `words` (word, n).

    A word's form is its near word that occurs most (ties: the smallest), if it occurs `factor` times as often at least;
    root follows forms to the last, and is the word itself without a form. n_near is 0 and form null without near words.
    No words give no rows.
    """
    words = common.stored(words)
    is_form = F.col("best_n") >= factor * F.col("n")
    rows = words.join(near_words(words), "word", "left")
    rows = common.stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variants() of the vocabulary of whole texts."""
    return variants(vocabulary(docs, id_col, text_col))
