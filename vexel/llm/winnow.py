"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken 2003), in DataFrame functions only.

The hash of every K bytes of the UTF-8 text is taken, from each byte on. Of every W hashes in a row the least is kept, of
equal ones the rightmost, with its position. So two texts that share K + W - 1 bytes in a row share a kept hash, wherever
the bytes stand and whether or not they hold spaces; K + W - 1 characters have that many bytes at least.

Long texts are worked off in chunks that overlap by FEW bytes, so only kept entries grow with a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K, W = 16, 16  # bytes of a gram; hashes of a window, a power of two
CHUNK = 1024  # windows that are looked at at once
PLACES = 32  # low bits of an entry, which hold its hash; its position is above them
BLOCK_ROWS = 50_000  # documents that are ordered together
STEP = 512  # bounds of blocks in a list
FEW = K + W - 2  # bytes that two overlapping windows share, and the most of a text without a window
NONE = "array<long>"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _doubled(x: Column, step: int) -> Column:
    """The least of each entry and that `step` places on; the shorter array goes on with nulls."""
    return _let(x, lambda v: F.zip_with(v, F.slice(v, step + 1, F.size(v)), lambda a, b: F.least(a, b)))


def _chunk(piece: Column, start: Column) -> Column:
    """The kept entries of the windows of a piece of at least K + W - 1 bytes that starts at `start`."""
    n = F.octet_length(piece)
    # A hash, then how far its place is from the end: the least one is the rightmost of equal hashes.
    least = F.transform(F.sequence(F.lit(1), n - (K - 1)), lambda i: F.shiftleft(_low(F.xxhash64(F.substring(piece, i, F.lit(K)))), 31).bitwiseOR((n - i).cast("long")))
    step = 1
    while step < W:
        least = _doubled(least, step)
        step *= 2
    windows = F.array_distinct(F.slice(least, 1, n - FEW))
    place = lambda x: start + n - 1 - x.bitwiseAND(F.lit((1 << 31) - 1).cast("long"))
    return F.transform(windows, lambda x: _entry(F.shiftright(x, 31), place(x)))


def _entry(h: Column, at: Column) -> Column:
    return F.shiftleft(at.cast("long"), PLACES).bitwiseOR(_low(h))


def kept(text: Column, offset: Column | None = None) -> Column:
    """The kept entries of a binary column in order of position, array<long>; `offset` is added to positions.

    Texts of fewer than K bytes have one entry for them all, those of fewer than W grams that of the least; empty texts
    have none.
    """
    from_ = F.lit(0) if offset is None else offset

    def of(t: Column) -> Column:
        n = F.octet_length(t)
        chunks = F.transform(F.sequence(F.lit(0), n - FEW - 1, F.lit(CHUNK)), lambda at: _let(F.substring(t, at + 1, F.lit(CHUNK + FEW)), lambda p: _chunk(p, from_ + at)))
        grams = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.struct(_low(F.xxhash64(F.substring(t, i + 1, F.lit(K)))).alias("h"), (-i).alias("i")))
        one = _let(F.array_min(grams), lambda g: _entry(g["h"], from_ - g["i"]))
        return F.when(n > FEW, F.array_distinct(F.flatten(chunks))).when(n >= K, F.array(one)).when(n > 0, F.array(_entry(F.xxhash64(t), from_))).otherwise(F.array().cast(NONE))

    return _let(text, of)


def hashes(entries: str | Column) -> Column:
    return F.array_distinct(F.transform(entries, _low))


def positions(entries: str | Column) -> Column:
    """array<struct<hash, position>>, positions counted in bytes."""
    return F.transform(entries, lambda x: F.struct(_low(x).alias("hash"), F.shiftright(x, PLACES).alias("position")))


def digest(entries: str) -> Column:
    """32 hex digits that equal lists of kept entries share."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), entries)), 16, "0") for i in (1, 2)]))


def likeness(a: str, b: str) -> Column:
    """Shared part of two sets of hashes; 1 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def joined(own: Column, following: Column, text: Column, first: Column, size: Column) -> Column:
    """The kept entries of a text made of the first `first` bytes of one text and the first `size` bytes of another,
    from the kept entries of the two; only windows near the two cuts are looked at. `text` is the whole new text.

    A window within a beginning keeps what it keeps in the whole text, and an entry that stands before the last such
    window's start is kept by one of them.
    """
    in_first, in_second = first - FEW, size - FEW  # windows within either beginning
    seam = F.greatest(F.lit(0), in_first - W)
    end = F.greatest(F.lit(0), in_second - W)
    before = lambda entries, n: F.filter(entries, lambda x: F.shiftright(x, PLACES) < n)
    moved = F.transform(before(following, in_second), lambda x: x + F.shiftleft(first.cast("long"), PLACES))
    second = F.when(in_second > 0, F.substring(text, first + end + 1, size - end)).otherwise(F.lit(b""))
    cuts = F.array(F.struct(F.substring(text, seam + 1, first + FEW - seam).alias("t"), seam.alias("at")), F.struct(second.alias("t"), (first + end).alias("at")))
    near = F.flatten(F.transform(cuts, lambda c: kept(c["t"], c["at"])))
    return F.array_sort(F.array_distinct(F.concat(before(own, in_first), near, moved)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, entries array<struct<hash, position>>) of whole texts; null counts as empty."""
    rows = common.keyed(docs, id_col, text_col).withColumn("kept", kept(F.col("text")))
    return rows.select(F.col("id").alias("doc_id"), positions("kept").alias("entries"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Adds `block`, a number that grows with (id, hash); about BLOCK_ROWS rows share one. Their bounds, 16 bytes for each
    BLOCK_ROWS documents, are broadcast as lists of STEP and looked up in two steps."""
    keys, key = rows.select("id", "hash"), F.struct("id", "hash")
    n = max(2 * common.parts(rows.sparkSession), keys.count() // BLOCK_ROWS)
    lows = common.stored(keys.repartitionByRange(n, "id", "hash").groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("low")))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("low"))  # over one small row for each block
    table = lows.withColumn("i", number - 1).groupBy(F.floor(F.col("i") / STEP).alias("coarse")).agg(F.sort_array(F.collect_list("low")).alias("lows"))
    first = table.agg(F.sort_array(F.collect_list(F.col("lows")[0])).alias("firsts"))
    below = lambda list_: F.size(F.filter(list_, lambda b: b <= key))
    found = rows.join(F.broadcast(first)).withColumn("coarse", F.greatest(below("firsts") - 1, F.lit(0)).cast("long")).drop("firsts")
    return found.join(F.broadcast(table), "coarse", "left").withColumn("block", F.col("coarse") * (STEP + 1) + F.coalesce(below("lows"), F.lit(0))).drop("coarse", "lows")


def _ordered(rows: DataFrame) -> tuple[DataFrame, Window]:
    """The rows dealt by block and sorted in it, with the first row of the next block (after the last block that of the
    first) as `edge` at the end of each, and the window to look ahead in. The texts are shuffled once."""
    rows = _blocks(rows)
    # The first row of each block: at most one a block, found by its id and a hash of its text.
    first = rows.groupBy("block").agg(F.min(F.struct("id", "hash")).alias("f"))
    whole = Window.partitionBy(F.lit(0))  # over one small row for each block
    heads = first.select("f.id", "f.hash", "block", F.coalesce(F.lag("block").over(whole.orderBy("block")), F.max("block").over(whole)).alias("to"))
    edge = rows.alias("r").join(F.broadcast(heads).alias("h"), (F.col("r.id") == F.col("h.id")) & (F.col("r.hash") == F.col("h.hash")) & (F.col("r.block") == F.col("h.block")))
    edge = edge.groupBy("h.to", "r.id", "r.hash").agg(F.min("r.text").alias("text"), F.first("r.unnamed").alias("unnamed"))
    both = rows.withColumn("edge", F.lit(False)).unionByName(edge.withColumnRenamed("to", "block").withColumn("edge", F.lit(True)))
    order = ["edge", "id", "hash", "text"]
    return both.repartition("block").sortWithinPartitions("block", *order), Window.partitionBy("block").orderBy(*order)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document, in ascending order of doc_id: nulls first (as the least long), equal ids by their text's hash and text; the
    first document follows the last, a lone one itself. Null text counts as empty; one row for each row of docs; no
    other columns.
    """
    rows = common.keyed(docs, id_col, text_col, binary=False)
    rows, w = _ordered(rows.select(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("hash"), "text", F.col("id").isNull().alias("unnamed")))
    rows = rows.withColumn("kept", kept(F.col("text").cast("binary")))
    rows = rows.withColumn("next", F.lead("text").over(w)).withColumn("following", F.lead("kept").over(w)).where(~F.col("edge"))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("a", F.substring(F.col("text"), F.lit(1), F.length("text") - half).cast("binary")).withColumn("b", F.substring(F.col("next"), F.lit(1), half).cast("binary"))
    rows = rows.withColumn("edited", F.concat("a", "b"))
    rows = rows.withColumn("edited_kept", joined(F.col("kept"), F.col("following"), F.col("edited"), F.octet_length("a"), F.octet_length("b")))
    rows = rows.select(
        F.when(~F.col("unnamed"), F.col("id")).alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        digest("kept").alias("fingerprint"), digest("edited_kept").alias("edited_fingerprint"), hashes("kept").alias("own"), hashes("edited_kept").alias("changed"), hashes("following").alias("other"),
    )
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("own", "changed").alias("near_edited"), likeness("own", "other").alias("near_next"))
