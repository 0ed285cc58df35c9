"""Nearest-neighbour graphs by descent, and layouts in the plane that keep neighbours (McInnes et al. 2018).

The graph (Dong et al. 2011): vectors are dealt around pivots and find their nearest within their own block; then, in
stored rounds, the neighbours of a node, and those that have it as a neighbour, are compared with each other, until few
lists change. No task sees more than a block, or the lists of some nodes.

The layout pulls neighbours together and pushes random nodes apart. Nodes are dealt into random blocks; a task moves
those of its block for some epochs, with their neighbours in other blocks held where they are, then all are dealt anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Rounds, stored
from . import cells, tiles

K = 15
DEALS = 3  # times that vectors are dealt into blocks, around different pivots
BLOCK, PER_CELL = 4096, 1024  # vectors of a block at most, and for each pivot
WIDE = 2  # times k: the neighbours that are kept during the descent
ROUNDS = 8  # of descent at most
FEW = 0.01  # share of entries that change in the last round
LAYOUTS, EPOCHS = 10, 30  # rounds of the layout, and epochs in each
NODES = 20_000  # nodes of a layout block
NEGATIVES = 5
#: The curve 1 / (1 + A d^(2 B)) that fits a least distance of 0.1 at a spread of 1.
A, B = 1.577, 0.8951


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k most similar of each id; equal ones by a hash, so that copies don't all choose the same."""
    w = Window.partitionBy("id").orderBy(F.desc("sim"), F.xxhash64("id", "other"), "other")
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= k).drop("_i")


def _of_block(of: cells.Cells, k: int) -> DataFrame:
    """(id, other, sim): of each vector the k nearest in its own part of a cell."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = cells.unit(np.array(table.column("v").combine_chunks().flatten()).reshape(len(ids), -1))
        sim = x @ x.T
        np.fill_diagonal(sim, -np.inf)
        n = min(k, len(ids) - 1)
        top = np.argpartition(-sim, n - 1, axis=1)[:, :n] if n else np.zeros((len(ids), 0), int)
        return pa.table({"id": np.repeat(ids, n), "other": ids[top].ravel(), "sim": np.take_along_axis(sim, top, 1).ravel()})

    return of.rows.groupBy("cell", "part").applyInArrow(run, "id long, other long, sim double")


def _joined(batches):
    """Pairs of the members of a node's list (u, m, fresh, v, least), in order of u: (id, other, sim) where the pair
    holds a fresh member and is nearer than the farthest neighbour that the id has."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        u, m, fresh, least = (t.column(c).to_numpy() for c in ("u", "m", "fresh", "least"))
        x = np.array(t.column("v").combine_chunks().flatten(), float).reshape(len(u), -1)
        edge = np.append(np.flatnonzero(np.append(True, u[1:] != u[:-1])), len(u))
        out = []
        for s, e in zip(edge, edge[1:]):
            sim = x[s:e] @ x[s:e].T
            ok = fresh[s:e, None] | fresh[None, s:e]
            np.fill_diagonal(ok, False)
            i, j = np.nonzero(ok & (sim > least[s:e, None]))
            out.append((m[s + i], m[s + j], sim[i, j]))
        a, b, c = (np.concatenate([o[n] for o in out]) if out else np.zeros(0) for n in range(3))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["id", "other", "sim"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        u = held.column("u").to_numpy()
        cut = int(np.searchsorted(u, u[-1]))  # the last list may go on
        if cut:
            yield pairs(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield pairs(held)


def _candidates(graph: DataFrame, k: int) -> DataFrame:
    """(u, m, fresh): neighbours of each u and about k of those that have u as theirs, by a hash."""
    back = graph.select(F.col("other").alias("u"), F.col("id").alias("m"), "fresh")
    many = back.groupBy("u").agg(F.count("*").alias("c"))
    few = back.join(many, "u").where(F.pmod(F.xxhash64("u", "m"), F.col("c")) < k).drop("c")
    return graph.select(F.col("id").alias("u"), F.col("other").alias("m"), "fresh").unionByName(few).groupBy("u", "m").agg(F.max("fresh").alias("fresh"))


def nearest(vectors: DataFrame, k: int = K, id_col: str = "node_id", v: str = "v", rounds: int = ROUNDS, few: float = FEW, block: int = BLOCK, per_cell: int = PER_CELL) -> DataFrame:
    """(id, other, sim): of each vector k neighbours of large cosine, nearly the nearest ones (see the tests for their
    share). All others, if there are k or fewer; zero and null vectors take no part. Ids are distinct whole numbers."""
    keep = Rounds(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(v).alias("v"), F.lit(0).alias("all")).where(F.exists("v", lambda x: x != 0))
    found = None
    wide = WIDE * k
    for seed in range(DEALS):
        of = cells.dealt(rows, "all", "id", "v", block=block, angles=True, per_cell=per_cell, seed=seed)
        found = _of_block(of, wide) if found is None else found.unionByName(_of_block(of, wide))
        if len(of.table) <= 1 and (of.table["parts"] <= 1).all():  # one block holds them all, so its lists are exact
            return _best(found, k)
    # In the blocks, the same pair's cosine may differ in its last bits.
    once = found.groupBy("id", "other").agg(F.max("sim").alias("sim"))
    now = keep.keep(_best(once, wide).withColumn("fresh", F.lit(True)))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    units = stored(rows.select("id", F.explode(F.array(F.struct("v", length.alias("n")))).alias("h")).select("id", F.transform("h.v", lambda x: (x / F.col("h.n")).cast("float")).alias("v")))
    n = units.count()
    for _ in range(rounds):
        own = now.groupBy("id").agg(F.min("sim").alias("least"), F.count("*").alias("c")).select("id", F.when(F.col("c") >= min(wide, n - 1), F.col("least")).otherwise(F.lit(-2.0)).alias("least"))
        members = units.join(own, "id", "left").select(F.col("id").alias("m"), "v", F.coalesce("least", F.lit(-2.0)).alias("least"))
        lists = _candidates(now, wide).join(members, "m").select("u", "m", "fresh", "v", "least")
        new = lists.repartition("u").sortWithinPartitions("u").mapInArrow(_joined, "id long, other long, sim double")
        both = now.select("id", "other", "sim", F.lit(False).alias("fresh")).unionByName(new.select("id", "other", "sim", F.lit(True).alias("fresh")))
        keep.next()
        now = keep.keep(_best(both.groupBy("id", "other").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh")), wide))
        if now.where("fresh").count() <= few * wide * n:
            break
    return _best(now.select("id", "other", "sim"), k)


def _merged(best: tuple[np.ndarray, np.ndarray], sim: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest entries (values, ids) of each row of `best` and of `sim`, in descending order, equal ones by id."""
    n, k = best[0].shape
    least = best[0][:, -1]
    if sim.shape[1] > k and np.isneginf(least).any():  # a list that isn't full would take all
        least = np.maximum(least, np.partition(sim, -k, axis=1)[:, -k])
    i, j = np.nonzero((sim >= least[:, None]) & (sim > -np.inf))
    if not len(i):
        return best
    row, value, other = np.append(np.repeat(np.arange(n), k), i), np.append(best[0], sim[i, j]), np.append(best[1], ids[j])
    by = np.lexsort((other, -value, row))
    row = row[by]
    by = by[np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row] < k]
    return value[by].reshape(n, k), other[by].reshape(n, k)


def exact(vectors: DataFrame, k: int = K, id_col: str = "node_id", v: str = "v", block: int | None = None) -> DataFrame:
    """(id, other, sim): of each vector the k of largest cosine, equal ones by id; fewer where there are fewer. All pairs
    are compared: a task holds a tile with the best that its vectors have so far, while all others pass by. Zero and
    null vectors take no part. Ids are distinct whole numbers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(v).alias("v")).where(F.exists("v", lambda x: x != 0))
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    count = tiles.tiles_of(n, dims, 4 * vectors.sparkSession.sparkContext.defaultParallelism, block)

    def lists(held) -> pa.RecordBatch:
        found = [(np.repeat(a.ids, k), other.ravel(), value.ravel()) for a, (value, other) in held]
        ids, other, value = (np.concatenate([f[c] for f in found]) for c in range(3))
        full = value > -np.inf
        return pa.RecordBatch.from_arrays([pa.array(x[full]) for x in (ids, other, value)], ["id", "other", "sim"])

    def kernel(batches):
        now, held = None, []
        for group, side, _, chunk in tiles.read(batches):
            if group != now:
                if held:
                    yield lists(held)
                now, held = group, []
            best = np.full((len(chunk.ids), k), -np.inf), np.zeros((len(chunk.ids), k), np.int64)
            for at, (a, known) in enumerate(held):
                sim = tiles.cosines(a, chunk)
                held[at] = a, _merged(known, sim, chunk.ids)
                if not side:
                    best = _merged(best, np.ascontiguousarray(sim.T), a.ids)
            if not side:
                sim = tiles.cosines(chunk, chunk)
                np.fill_diagonal(sim, -np.inf)
                held.append((chunk, _merged(best, sim, chunk.ids)))
        if held:
            yield lists(held)

    return tiles.each_with_all(tiles.dealt(rows, "id", "v", n, count), count).mapInArrow(kernel, "id long, other long, sim double")


def fuzzy(graph: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: how much the two are neighbours, by distances 1 - sim of each node's list: 1 for its
    nearest, and falling so that a list of k sums up to log2 k; the two views are joined as probabilities."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten()
            other, d = flat.field("other").to_numpy(), np.maximum(1 - flat.field("sim").to_numpy(), 0)
            wide = max(sizes.max(initial=0), 1)
            inside = np.arange(wide)[None] < sizes[:, None]
            m = np.full((len(ids), wide), np.inf)
            m[inside] = d
            rho = np.where(m > 0, m, np.inf).min(1)
            rho = np.where(np.isfinite(rho), rho, 0.0)[:, None]
            gap = np.where(inside, np.maximum(np.where(inside, m, 0) - rho, 0), np.inf)
            low, high = np.full(len(ids), 1e-12), np.full(len(ids), 1e3)
            for _ in range(60):
                mid = np.sqrt(low * high)
                over = np.exp(-gap / mid[:, None]).sum(1) > np.log2(np.maximum(sizes, 2))
                low, high = np.where(over, low, mid), np.where(over, mid, high)
            w = np.exp(-gap / np.sqrt(low * high)[:, None])[inside]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(other), pa.array(w)], ["id", "other", "w"])

    lists = graph.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("other", "sim"))).alias("l"))
    w = lists.mapInArrow(run, "id long, other long, w double")
    both = w.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.sum("w").alias("s"), F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(F.lit(0.0)).alias("p"))
    return both.select("a", "b", F.round(F.col("s") - F.col("p"), 9).alias("weight"))


def _moved(ids, xy, a, other_xy, inner, weight, epochs: np.ndarray, total: int, rng) -> np.ndarray:
    """Positions of a block's nodes after some epochs. Edge e pulls its node a[e] to node inner[e] of the block, or, if that
    is -1, to other_xy[e]; it does so as often as its weight says, and each time a pushes NEGATIVES random nodes off."""
    xy = xy.copy()
    n = len(ids)
    for epoch in epochs:
        rate = 1 - epoch / total
        e = np.flatnonzero(rng.random(len(a)) < weight)
        at, to = a[e], np.where((inner[e] >= 0)[:, None], xy[inner[e]], other_xy[e])
        gap = xy[at] - to
        d2 = (gap * gap).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            pull = np.where(d2 > 0, -2 * A * B * d2 ** (B - 1) / (1 + A * d2**B), 0.0)
        step = np.clip(pull[:, None] * gap, -4, 4)
        push_at = np.repeat(at, NEGATIVES)
        off = rng.integers(0, n, len(push_at))
        gap = xy[push_at] - xy[off]
        d2 = (gap * gap).sum(1)
        force = 2 * B / ((0.001 + d2) * (1 + A * d2**B))
        push = np.where((push_at != off)[:, None], np.clip(force[:, None] * gap, -4, 4), 0.0)
        change = np.zeros_like(xy)
        for c in range(2):
            change[:, c] = np.bincount(at, step[:, c], n) + np.bincount(push_at, push[:, c], n)
        xy += rate * np.clip(change, -8, 8)
    return xy


def _turn(turn: int, epochs: int, total: int, top: float, seed: int):
    """Moves the nodes of a block (block, id, x, y, near) in one round."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        ids, x, y = (table.column(c).to_numpy()[order] for c in ("id", "x", "y"))
        lists = table.column("near").combine_chunks().take(pa.array(order))
        sizes = np.array(lists.value_lengths().fill_null(0))
        flat = lists.flatten()
        other, ox, oy, w = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("other", "x", "y", "weight"))
        place = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
        inner = np.where(ids[place] == other, place, -1)
        rng = np.random.default_rng([seed, turn, int(table.column("block")[0].as_py())])
        xy = _moved(ids, np.stack((x, y), 1), np.repeat(np.arange(len(ids)), sizes), np.stack((ox, oy), 1), inner, w / top, np.arange(turn * epochs, (turn + 1) * epochs), total, rng)
        return pa.table({"node_id": ids, "x": xy[:, 0], "y": xy[:, 1]})

    return run


def layout(graph: DataFrame, start: DataFrame, rounds: int = LAYOUTS, epochs: int = EPOCHS, nodes: int = NODES, seed: int = 42) -> DataFrame:
    """(node_id, x, y) of the nodes of `start` (node_id, x, y), a first layout, moved by the neighbours of `graph` (id,
    other, sim). Nodes without neighbours are only pushed about, by none, and stay."""
    keep = Rounds(graph.sparkSession)
    edges = fuzzy(graph)
    edges = stored(edges.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"), "weight")))
    top = edges.agg(F.max("weight")).first()[0] or 1.0
    ends = start.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    n = ends[4]
    # Rounded, as small differences, such as of the order of sums, would grow over the epochs.
    scale = lambda c, lo, hi: F.round((F.col(c) - F.lit((lo + hi) / 2)) * F.lit(20 / (hi - lo) if hi > lo else 0.0), 6)
    now = start if not n else start.select(F.col("node_id").cast("long").alias("node_id"), scale("x", ends[0], ends[1]).alias("x"), scale("y", ends[2], ends[3]).alias("y"))
    blocks = max(1, -(-n // nodes))
    for turn in range(rounds if n else 0):
        others = now.select(F.col("node_id").alias("other"), "x", "y")
        near = edges.join(others, "other").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("other", "x", "y", "weight"))).alias("near"))
        here = now.withColumnRenamed("node_id", "id").join(near, "id", "left")
        block = F.pmod(F.xxhash64(F.lit(turn), "id"), F.lit(blocks)).alias("block")
        keep.next()
        now = keep.keep(here.withColumn("block", block).groupBy("block").applyInArrow(_turn(turn, epochs, rounds * epochs, top, seed), "node_id long, x double, y double"))
    return now


def projected(vectors: DataFrame, k: int = K, id_col: str = "node_id", v: str = "v", **how) -> DataFrame:
    """(node_id, x, y): the layout of the vectors' neighbour graph, from principal components on. Zero and null vectors
    take no part; no vectors give no rows."""
    from .diverse import projected as principal

    rows = vectors.select(F.col(id_col).alias("node_id"), F.col(v).alias("v")).where(F.exists("v", lambda x: x != 0))
    if rows.isEmpty():
        return vectors.sparkSession.createDataFrame([], "node_id long, x double, y double")
    return layout(stored(nearest(rows, k)), stored(principal(rows)), **how)
