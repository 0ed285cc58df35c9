"""Minimum-cost multicut on signed edges, by parallel greedy contraction and moves of nodes.

The edges (src, dst, weight) join like nodes by positive and unlike ones by negative weights. A clustering costs the
weights of the edges between its clusters; the cheapest one is sought, with any number of clusters. Finding it is
NP-hard, so this is a heuristic: the greedy additive contraction of Keuper et al. (2015), many contractions at once.

All choices are made by weight and then by the smaller node, and weights are added up as whole multiples of UNIT, so
the result doesn't hang on the order of rows. Weights are finite and below 10^9 in size, node ids not negative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Rounds, stored

UNIT = 1e-9  # of a weight
MOST = 500  # rounds of contraction
MOVES = 8  # rounds of moves


def signed(edges: DataFrame, bias: float, weight: str = "weight") -> DataFrame:
    """(src, dst, weight): weights of [0, 1] less a bias, so that edges below it speak against a join."""
    return edges.select("src", "dst", (F.col(weight) - F.lit(bias)).alias("weight"))


def _plain(edges: DataFrame) -> DataFrame:
    """One edge for each pair src < dst, parallel ones summed, in whole units; self-loops and null weights go."""
    units = F.round(F.col("weight").cast("double") / UNIT).cast("long")
    return _summed(edges.where("src <> dst and weight is not null and not isnan(cast(weight as double))").select("src", "dst", units.alias("weight")))


def _summed(edges: DataFrame) -> DataFrame:
    rows = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight").unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), "weight"))


def _proposals(edges: DataFrame) -> DataFrame:
    """(u, v, weight): each node's best edge of positive weight."""
    best = _both(edges.where("weight > 0")).groupBy("u").agg(F.max(F.struct("weight", (-F.col("v")).alias("v"))).alias("b"))
    return best.select("u", (-F.col("b.v")).alias("v"), "b.weight")


def _merges(edges: DataFrame, proposals: DataFrame) -> DataFrame:
    """(node, root) of the nodes that are contracted into another one or have others contracted into them.

    Two nodes that propose each other join. Others join the pair that holds the node they propose, so that a hub doesn't
    take a round for each of its nodes; but of two that a negative edge sets apart, the one of the weaker proposal (ties:
    the larger id) waits, as does one that a negative edge sets apart from the pair.
    """
    p, q = proposals.alias("p"), proposals.alias("q")
    mutual = p.join(q, (F.col("p.v") == F.col("q.u")) & (F.col("q.v") == F.col("p.u"))).select(F.col("p.u").alias("node"), F.least("p.u", "p.v").alias("root"))
    core = mutual.select("node", "root", F.lit((1 << 63) - 1).alias("strength"))
    hubs = mutual.select(F.col("node").alias("v"), "root")
    others = proposals.join(mutual.select(F.col("node").alias("u")), "u", "left_anti").join(hubs, "v").select(F.col("u").alias("node"), "root", F.col("weight").alias("strength"))
    groups = core.unionByName(others)
    a = groups.select(F.col("node").alias("src"), F.col("root").alias("a"), F.col("strength").alias("sa"))
    b = groups.select(F.col("node").alias("dst"), F.col("root").alias("b"), F.col("strength").alias("sb"))
    apart = edges.where("weight < 0").select("src", "dst").join(a, "src").join(b, "dst").where("a = b")
    waits = apart.select(F.when(F.col("sb") > F.col("sa"), F.col("src")).otherwise(F.col("dst")).alias("node")).distinct()
    return groups.select("node", "root").join(waits, "node", "left_anti")


def _contracted(edges: DataFrame, merges: DataFrame) -> DataFrame:
    a, b = (merges.select(F.col("node").alias(c), F.col("root").alias(f"to_{c}")) for c in ("src", "dst"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("to_src", "src").alias("src"), F.coalesce("to_dst", "dst").alias("dst"), "weight")
    return _summed(moved)


def contracted(edges: DataFrame, most: int = MOST) -> DataFrame:
    """(node_id, cluster_id) by greedy contraction until no positive edge is left; a cluster bears its smallest node.

    RuntimeError after `most` rounds: each contracts the strongest edge at least, mostly far more.
    """
    rounds = Rounds(edges.sparkSession)
    now = rounds.keep(_plain(edges))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).where("node_id is not null").distinct()
    labels = rounds.keep(nodes.withColumn("cluster_id", F.col("node_id")))
    for _ in range(most):
        if now.where("weight > 0").isEmpty():
            return labels
        merges = rounds.keep(_merges(now, _proposals(now)))
        rounds.next()
        now = rounds.keep(_contracted(now, merges))
        roots = merges.select(F.col("node").alias("cluster_id"), "root")
        labels = rounds.keep(labels.join(roots, "cluster_id", "left").select("node_id", F.coalesce("root", "cluster_id").alias("cluster_id")))
    raise RuntimeError(f"contracted: no end after {most} rounds")


def moved(edges: DataFrame, labels: DataFrame, most: int = MOVES) -> DataFrame:
    """Labels after rounds in which nodes go where they gain most: to a neighbouring cluster or one of their own.

    Of neighbours that gain by a move only that with the largest gain (ties: the smaller id) goes, so that gains add up
    and the cost falls in each round. Ends early when no node gains. A cluster bears its smallest node.
    """
    rounds = Rounds(edges.sparkSession)
    plain = stored(_both(_plain(edges)))
    now = labels
    for _ in range(most):
        of = now.select(F.col("node_id").alias("v"), F.col("cluster_id").alias("c"))
        sums = plain.join(of, "v").groupBy("u", "c").agg(F.sum("weight").alias("s"))
        own = now.select(F.col("node_id").alias("u"), F.col("cluster_id").alias("own"))
        best = sums.join(own, "u").groupBy("u", "own").agg(
            F.coalesce(F.max(F.when(F.col("c") == F.col("own"), F.col("s"))), F.lit(0)).alias("stay"),
            F.max(F.when(F.col("c") != F.col("own"), F.struct("s", (-F.col("c")).alias("c")))).alias("b"),
        )
        # A new cluster takes a name that no cluster has: the bitwise complement of the node, made plain by renamed().
        to = F.when(F.coalesce(F.col("b.s"), F.lit(-1)) > 0, -F.col("b.c")).otherwise(F.bitwise_not("u"))
        gains = best.select("u", to.alias("to"), (F.greatest(F.coalesce(F.col("b.s"), F.lit(0)), F.lit(0)) - F.col("stay")).alias("gain")).where("gain > 0")
        gains = rounds.keep(gains)
        if gains.isEmpty():
            break
        a, b = gains.select("u", F.col("gain").alias("ga")), gains.select(F.col("u").alias("v"), F.col("gain").alias("gb"))
        near = plain.join(a, "u").join(b, "v").where("gb > ga or (gb = ga and v < u)").select("u").distinct()
        # Nodes that aren't neighbours may still pass each other's clusters; their sums don't change by that.
        go = gains.join(near, "u", "left_anti").select(F.col("u").alias("node_id"), "to")
        rounds.next()
        now = rounds.keep(renamed(now.join(go, "node_id", "left").select("node_id", F.coalesce("to", "cluster_id").alias("cluster_id"))))
    return now


def renamed(labels: DataFrame) -> DataFrame:
    """Each cluster bears its smallest node."""
    names = labels.groupBy("cluster_id").agg(F.min("node_id").alias("name"))
    return labels.join(names, "cluster_id").select("node_id", F.col("name").alias("cluster_id"))


def cost(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: cost, the weights between clusters, and n_cut, the edges between them."""
    a, b = (labels.select(F.col("node_id").alias(c), F.col("cluster_id").alias(f"of_{c}")) for c in ("src", "dst"))
    cut = _plain(edges).join(a, "src").join(b, "dst").where("of_src <> of_dst")
    return cut.agg((F.coalesce(F.sum("weight"), F.lit(0)) * UNIT).alias("cost"), F.count("*").alias("n_cut"))


def multicut(edges: DataFrame, moves: int = MOVES) -> DataFrame:
    """(node_id, cluster_id) of all nodes with an edge: contraction, then moves. Parallel edges are summed, self-loops and
    null weights ignored (their nodes stay); no edges give no rows."""
    labels = contracted(edges)
    return moved(edges, labels, moves) if moves else labels
