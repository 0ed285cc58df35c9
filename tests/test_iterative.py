"""Operators that go over stored rounds or blocks, against plain computations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.operators import cells, diverse, graph, multicut, neighbours, quality, ranking, sampling, selection
from vexel.storage import stored


def partitions(n):
    """All ways to cluster n nodes, as lists of labels."""

    def grow(labels, top):
        if len(labels) == n:
            yield labels
            return
        for c in range(top + 1):
            yield from grow([*labels, c], max(top, c + 1))

    return grow([0], 1)


def test_multicut_against_the_optimum(spark):
    """Thirty graphs of up to eight nodes in one table."""
    rng = np.random.default_rng(3)
    graphs, rows = [], []
    for g in range(30):
        n = int(rng.integers(3, 9))
        e = [(i, j, float(np.round(rng.normal(0.1, 1), 2))) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.8]
        graphs.append((n, e))
        rows += [(10 * g + i, 10 * g + j, w) if rng.random() < 0.5 else (10 * g + j, 10 * g + i, w) for i, j, w in e]
    rows += [(500, 500, 3.0), (501, 502, None), (503, 504, 1.0), (504, 503, -2.0)]  # a loop, a null and two that sum up below 0
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    labels = multicut.contracted(edges)
    first, last = ({r.node_id: r.cluster_id for r in df.collect()} for df in (labels, multicut.moved(edges, labels)))
    again = {r.node_id: r.cluster_id for r in multicut.multicut(edges.repartition(7)).collect()}
    assert again == last
    assert all(last[i] == i for i in (500, 501, 502, 503, 504))
    optimal, gap, total = 0, 0.0, 0.0
    for g, (n, e) in enumerate(graphs):
        cut = lambda of: sum(w for i, j, w in e if of[i] != of[j])  # noqa: B023, E731
        best = min(map(cut, partitions(n)))
        greedy, found = (cut([of.get(10 * g + i, -1 - i) for i in range(n)]) for of in (first, last))
        assert best - 1e-9 <= found <= greedy + 1e-9
        optimal += abs(found - best) < 1e-9
        gap, total = gap + found - best, total + abs(best)
    assert optimal >= 24 and gap <= 0.02 * total
    whole = multicut.cost(edges.where("src < 500"), spark.createDataFrame(list(last.items()), "node_id long, cluster_id long")).first()
    assert whole.cost == pytest.approx(sum(w for i, j, w in rows if i < 500 and last[i] != last[j]))


def test_multicut_of_a_hub_takes_few_rounds(spark):
    edges = spark.range(1, 400).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), (1 / F.col("id")).alias("weight"))
    assert multicut.contracted(edges, most=2).select("cluster_id").distinct().count() == 1
    assert multicut.multicut(edges.limit(0)).collect() == []


def clumps(rng, n=600, dims=12, k=6, spread=0.05):
    centres = rng.normal(size=(k, dims))
    of = rng.integers(0, k, n)
    x = centres[of] + spread * rng.normal(size=(n, dims))
    x[5], x[6], x[7] = x[4], x[4], 0.0  # copies and a zero vector
    return x, of


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95, 0.999])
def test_similar_pairs(spark, threshold):
    x, _ = clumps(np.random.default_rng(0))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9000, None)], "node_id long, v array<double>")
    whole = {(r.src, r.dst) for r in graph.pairwise_cosine(v.where("v is not null")).where(F.col("sim") >= threshold).collect()}
    for block in (2048, 40):
        found = graph.similar_pairs(v, threshold, per_cell=20, block=block).collect()
        assert len(found) == len(whole) and {(r.src, r.dst) for r in found} == whole and all(r.src < r.dst for r in found)


def test_far_cells_are_skipped(spark):
    x, _ = clumps(np.random.default_rng(0))
    v = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x) if i != 7], "id long, v array<double>, all int")
    of = cells.dealt(v, "all", "id", "v", angles=True, per_cell=20)
    n = len(of.table)
    kept = [int(graph._near_cells(of, t).sum()) for t in (-1.0, 0.5, 0.9, 0.99)]
    assert kept[0] == n * (n + 1) // 2 and kept[1] < 0.5 * kept[0] and kept[1] >= kept[2] >= kept[3] >= n
    assert graph.similar_pairs(v.limit(0), 0.5, "id").collect() == []


@pytest.mark.parametrize("pivots, block", [(1024, 2048), (30, 7), (1, 5)])
def test_davies_bouldin_by_blocks(spark, pivots, block):
    rng = np.random.default_rng(1)
    x, _ = clumps(rng, 900, 6, 9)
    rows = [(i, c, "a") for i, c in enumerate(rng.integers(0, 150, 900).tolist())] + [(i, c, "b") for i, c in enumerate((np.arange(900) // 300).tolist())] + [(i, 0, "c") for i in range(900)]
    labels = spark.createDataFrame(rows, "node_id long, cluster_id long, config string")
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node_id long, v array<double>")

    def brute(config):
        of = np.array([c for _, c, k in rows if k == config])
        names = [c for c in np.unique(of) if (of == c).sum() > 1]
        centre = np.array([x[of == c].mean(0) for c in names])
        s = np.array([np.sqrt(((x[of == c] - m) ** 2).sum(1)).mean() for c, m in zip(names, centre)])
        d = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2))
        with np.errstate(divide="ignore"):
            r = np.where(d > 0, (s[:, None] + s[None]) / d, 0)
        return r.max(1).mean()

    found = {r.config: r.davies_bouldin_score for r in quality.davies_bouldin(labels, points, pivots, block, 10).collect()}
    assert found["a"] == pytest.approx(brute("a")) and found["b"] == pytest.approx(brute("b")) and found["c"] is None


def test_davies_bouldin_leaves_blocks_out(spark):
    """Tight groups of clusters far from each other: only cells nearby can hold the largest ratio."""
    rng = np.random.default_rng(2)
    rows = [(i, (100.0 * (i % 20) + rng.normal(size=3)).tolist(), float(rng.random()), "a") for i in range(400)]
    of = cells.dealt(spark.createDataFrame(rows, "cluster_id long, c array<double>, s double, config string"), "config", "cluster_id", "c", "s", per_cell=10)
    first = quality._worst(of, np.eye(len(of.table), dtype=bool))
    least = first.groupBy("key", "cell").agg(F.min("r").alias("least")).toPandas()
    skipped = quality._skipped(of, least, np.eye(len(of.table), dtype=bool))
    assert skipped.mean() > 0.5


def test_coincident_centroids_do_not_count(spark):
    points = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0]), (4, [9.0, 0.0]), (5, [11.0, 0.0])], "node_id long, v array<double>")
    labels = spark.createDataFrame([(i, i // 2, "x") for i in range(6)] + [(i, i // 2, "y") for i in range(4)], "node_id long, cluster_id long, config string")
    found = {r.config: r.davies_bouldin_score for r in quality.davies_bouldin(labels, points).collect()}
    assert found["x"] == pytest.approx(0.2) and found["y"] is None


def test_neighbours_found_by_descent(spark):
    """Small blocks, so that most neighbours have to be found by the rounds."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 10))
    x[:60] = x[0]
    x[7] = 0
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(5000, None)], "node_id long, v array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    sim = u @ u.T
    sim[7] = sim[:, 7] = -9
    np.fill_diagonal(sim, -9)
    kth = np.sort(sim, 1)[:, -10]
    found = neighbours.nearest(v, 10, block=64, per_cell=48).collect()
    assert len({(r.id, r.other) for r in found}) == len(found) == 10 * 899 and all(r.id != r.other and 7 not in (r.id, r.other) for r in found)
    assert all(r.sim == pytest.approx(sim[r.id, r.other], abs=1e-5) for r in found)
    assert np.mean([r.sim >= kth[r.id] - 1e-5 for r in found]) >= 0.9
    whole = neighbours.nearest(v, 10).collect()
    assert all(r.sim >= kth[r.id] - 1e-9 for r in whole)
    assert sorted((r.id, r.other) for r in neighbours.nearest(v.where("node_id in (3, 100, 200)"), 10).collect()) == [(3, 100), (3, 200), (100, 3), (100, 200), (200, 3), (200, 100)]
    assert neighbours.nearest(v.limit(0)).collect() == []


def test_fuzzy_weights(spark):
    g = spark.createDataFrame([(0, o, 1 - d) for o, d in ((1, 0.1), (2, 0.2), (3, 0.4), (4, 0.8))] + [(1, 0, 0.9)], "id long, other long, sim double")
    w = {(r.a, r.b): r.weight for r in neighbours.fuzzy(g).collect()}
    assert w[0, 1] == pytest.approx(1) and w[0, 1] > w[0, 2] > w[0, 3] > w[0, 4] > 0
    assert 1 + sum(w[0, o] for o in (2, 3, 4)) == pytest.approx(math.log2(4), abs=1e-3)


@pytest.mark.parametrize("nodes", [20_000, 150])
def test_layout_keeps_neighbours(spark, nodes):
    x, of = clumps(np.random.default_rng(8), 400, 12, 8, 0.4)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x) if i != 7], "node_id long, v array<double>")
    def kept(df):
        p = df.toPandas().sort_values("node_id")
        assert len(p) == 399 and np.isfinite(p[["x", "y"]].to_numpy()).all()
        z, own = p[["x", "y"]].to_numpy(), of[p["node_id"]]
        d = ((z[:, None] - z[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        return (own[np.argsort(d, 1)[:, :10]] == own[:, None]).mean()

    found = stored(neighbours.projected(v, nodes=nodes))
    assert kept(found) > max(0.85, kept(diverse.projected(v)))
    if nodes == 20_000:
        again = {r.node_id: (r.x, r.y) for r in neighbours.projected(v.repartition(3)).collect()}
        assert all(again[r.node_id] == pytest.approx((r.x, r.y)) for r in found.collect())
        assert neighbours.projected(v.limit(0)).collect() == []


def test_ranks_without_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(200_000).select(F.xxhash64("id").alias("x"), F.lit(1).alias("w"))
        r = ranking.numbered(df, ["x"], total="w").agg(F.count_distinct("rank").alias("n"), F.max("rank").alias("top"), F.max("running").alias("all")).first()
        assert (r.n, r.top, r["all"]) == (200_000, 200_000, 200_000)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_ranks_of_null_groups(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", None), (None, None)], "k string, x long")
    assert sorted(map(tuple, ranking.numbered(df, ["x"], ["k"]).collect()), key=str) == [("a", 2, 2), ("a", None, 1), (None, 1, 2), (None, 3, 3), (None, None, 1)]


@pytest.mark.parametrize("few", [4096, 5])
def test_medians(spark, few):
    rng = np.random.default_rng(6)
    cases = [rng.normal(size=1001), rng.normal(size=1000), np.repeat([1.0, 2.0], 500), np.repeat([1.0, 2.0, 7.0], [300, 1, 300]), np.exp(20 * rng.normal(size=777)), np.full(50, 3.5), np.array([4.0]), np.array([1.0, -2.0]), np.concatenate((np.zeros(400), rng.random(600)))]
    for x in cases:
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(3)
        assert selection.median(df, "x", few) == np.median(x)
    assert selection.median(spark.createDataFrame([(None,)], "x double"), "x") is None
    assert sampling.duration_stats(spark.createDataFrame([], "duration double")).first().median is None


def test_a_stratum_of_most_rows_is_spread(spark):
    """A period of 99 % of the rows: the same choice as by sorting it, and no task ranks it alone."""
    ids = [(f"id_{i}_2020-0{1 if i % 100 else 2}-01", float(i * 7 % 101) + 5 if i % 30 else None) for i in range(2000)]
    videos = spark.createDataFrame(ids, "video_id string, duration double")
    alloc = spark.createDataFrame([("2020-01", 1980, 300), ("2020-02", 20, 17)], "period string, n long, alloc long")
    import hashlib

    want = set()
    for period, n, take in (("2020-01", 1980, 300), ("2020-02", 20, 17)):
        own = sorted((r for r in ids if r[0].split("_")[2].startswith(period)), key=lambda r: (-(r[1] or -1), r[0]))
        long = {r[0] for r in own[: int(n * 0.8)]}
        want |= {r[0] for r in sorted(own, key=lambda r: (r[0] not in long, hashlib.md5(f"{r[0]}_42".encode()).hexdigest()))[:take]}
    picked = sampling.picked(videos, alloc)
    assert {r.video_id for r in picked.collect()} == want
    ranked = ranking.numbered(videos.withColumn("period", F.substring_index("video_id", "_", -1)), ["duration", "video_id"], ["period"])
    assert "_r" in ranked._jdf.queryExecution().executedPlan().toString()
    sizes = ranked.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 0.6 * 2000


def test_neighbours_are_the_nearest(spark):
    """Tiles of several chunks: no neighbour is missed, copies and short lists included."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2600, 6))
    x[:40] = x[0]
    x[7] = 0
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(5000, None)], "node_id long, v array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    sim = u @ u.T
    sim[7] = sim[:, 7] = -9
    np.fill_diagonal(sim, -9)
    want = -np.sort(-sim, 1)[:, :10]
    for block in (None, 1300, 90):
        found = neighbours.exact(v, 10, block=block).collect()
        assert len({(r.id, r.other) for r in found}) == len(found) == 10 * 2599 and all(r.id != r.other and 7 not in (r.id, r.other) for r in found)
        assert all(r.sim == pytest.approx(sim[r.id, r.other], abs=1e-12) for r in found)
        lists = {}
        for r in found:
            lists.setdefault(r.id, []).append(r.sim)
        assert all(np.allclose(sorted(lists[i], reverse=True), want[i], rtol=0, atol=1e-12) for i in lists)
    assert sorted((r.id, r.other) for r in neighbours.exact(v.where("node_id in (3, 100, 200)"), 10).collect()) == [(3, 100), (3, 200), (100, 3), (100, 200), (200, 3), (200, 100)]
    assert neighbours.exact(v.limit(0)).collect() == []


def moved_rows(df):
    """The largest number of rows that one of the plan's Python operators gave in a run, and the bytes that were shuffled."""
    df.collect()
    plan, rows, moved = [df._jdf.queryExecution().executedPlan()], [0], 0
    while plan:
        p = plan.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            plan.append(p.executedPlan())
            continue
        if "QueryStage" in name:
            plan.append(p.plan())
            continue
        m = p.metrics()
        if m.contains("pythonNumRowsReceived"):
            rows.append(m.apply("pythonNumRowsReceived").value())
        if name == "Exchange":
            moved += m.apply("shuffleBytesWritten").value()
        plan += [p.children().apply(i) for i in range(p.children().size())]
    return max(rows), moved


def test_no_pair_leaves_its_task_for_a_count(spark):
    from vexel.catalog import QUERIES
    from vexel.operators import clusters
    from vexel.sources import fixtures as fx

    v = fx.video_embeddings(spark, "/root/testdata/sf0.01")
    for name in ("similarity_range", "sim_histogram"):
        assert moved_rows(QUERIES[name](spark, "/root/testdata/sf0.01"))[0] < 10_000
    x, _ = clumps(np.random.default_rng(0))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node_id long, v array<double>")
    want = sorted(map(tuple, clusters.histogram(graph.pairwise_cosine(v).select(F.round("sim", 9).alias("sim")), "sim", 7).collect()))
    assert sorted(map(tuple, graph.similarity_histogram(v, 7, block=100).collect())) == [(b, pytest.approx(lo, abs=1e-12), pytest.approx(hi, abs=1e-12), n) for b, lo, hi, n in want]
    assert [r.n for r in graph.similarity_histogram(v.where("node_id between 4 and 6"), 3).orderBy("bin").collect()] == [3, 0, 0]
    assert graph.similarity_histogram(v.limit(1)).collect() == []
    assert graph.similarity_ends(v.limit(0)).collect() == [(None, None, 0)]


def test_pairs_are_shuffled_by_tiles(spark):
    """Each vector goes to each tile, not to each block of two thousand."""
    x = np.random.default_rng(1).normal(size=(30_000, 8)).astype(np.float32)
    v = stored(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node_id long, v array<double>"))
    found = graph.similarity_ends(v)
    assert moved_rows(found)[1] < 20 * x.nbytes and found.first().n == 30_000 * 29_999 // 2


def test_similar_pairs_are_shuffled_by_tiles(spark):
    """Random vectors, of which no cells can be skipped: each goes to each tile, not to each block."""
    x = np.random.default_rng(6).normal(size=(30_000, 8)).astype(np.float32)
    v = stored(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node_id long, v array<double>"))
    found = graph.similar_pairs(v, 0.98)
    rows = {(r.src, r.dst) for r in found.collect()}
    u = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = set()
    for a in range(0, len(u), 1000):
        i, j = np.nonzero(u[a : a + 1000] @ u.T >= 0.98)
        want |= {(int(s), int(d)) for s, d in zip(i + a, j) if s < d}
    assert rows == want
    assert moved_rows(found)[1] < 20 * x.nbytes


def test_ids_are_mapped_before_pairs(spark):
    x, _ = clumps(np.random.default_rng(0))
    v = spark.createDataFrame([(f"v{i}", r.tolist()) for i, r in enumerate(x)], "video_id string, v array<double>")
    ids = spark.createDataFrame([(f"v{i}", 1000 - i) for i in range(0, 600, 2)], "video_id string, node_id long")
    named = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node_id long, v array<double>")
    name = lambda c: F.concat(F.lit("v"), F.col(c).cast("string")).alias(c)
    whole = graph.mapped(graph.similar_pairs(named, 0.9).select(name("src"), name("dst"), "sim"), ids)
    got, want = ({(r.src, r.dst): r.sim for r in df.collect()} for df in (graph.mapped_pairs(v, ids, 0.9), whole))
    assert got == pytest.approx(want) and len(got) > 100


def passes(spark, run):
    """The result of run(videos) over 4000 videos of two periods, and how often it went over them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    v = stored(spark.range(4000).select(F.concat(F.lit("id_"), "id", F.when(F.col("id") % 4 == 0, "_2024-01-05").otherwise("_2024-02-05")).alias("video_id"), (5 + F.col("id") * 7919 % 1000 / 10).alias("duration")))
    rows = run(v.withColumn("duration", counted.asNondeterministic()("duration"))).collect()
    return rows, seen.value / 4000


def picks(rows, alloc):
    """(id, period) picked from (id, period, duration), plainly."""
    import hashlib

    out = set()
    for p, k in alloc.items():
        own = [r for r in rows if r[1] == p]
        own.sort(key=lambda r: (2, 0, r[0]) if r[2] is not None and math.isnan(r[2]) else (1, 0, r[0]) if r[2] is None else (0, -r[2], r[0]))
        late = {r[0] for r in own[math.floor(len(own) * 0.8) :]} if len(own) > k else set()
        own.sort(key=lambda r: (r[0] in late, hashlib.md5(f"{r[0]}_42".encode()).hexdigest(), r[0]))
        out |= {(r[0], p) for r in own[:k]}
    return out


def test_samples_are_picked_in_few_passes(spark):
    alloc = spark.createDataFrame([("2024-01", 1000, 100), ("2024-02", 3000, 2700)], "period string, n long, alloc long")
    rows, times = passes(spark, lambda v: sampling.picked(v, alloc))
    whole = [(f"id_{i}_2024-0{1 if i % 4 == 0 else 2}-05", f"2024-0{1 if i % 4 == 0 else 2}", 5 + i * 7919 % 1000 / 10) for i in range(4000)]
    assert {(r.video_id, r.period) for r in rows} == picks(whole, {"2024-01": 100, "2024-02": 2700}) and len(rows) == 2800
    assert times <= 2


def test_samples_are_trimmed_in_few_passes(spark):
    rows, times = passes(spark, lambda v: sampling.trimmed(v.select("video_id", F.lit("2024-01").alias("period"), "duration"), 1500, 20))
    assert len(rows) == 1500 and times <= 1


def test_odd_durations_are_picked(spark):
    nan, rows = float("nan"), []
    for m, (n, value) in enumerate([(1, lambda i: 1.0), (3, lambda i: float(i)), (700, lambda i: 5.0), (700, lambda i: None), (700, lambda i: nan if i % 2 else None), (1200, lambda i: [None, nan, 7.0, float(i)][i % 4])], 1):
        rows += [(f"id_{m}x{i}_2024-{m:02}-05", f"2024-{m:02}", value(i)) for i in range(n)]
    counts = {p: sum(r[1] == p for r in rows) for p in {r[1] for r in rows}}
    v = stored(spark.createDataFrame([(r[0], r[2]) for r in rows], "video_id string, duration double"))
    for share in (0.0, 0.1, 0.9, 1.0):
        alloc = {p: math.ceil(n * share) for p, n in counts.items()}
        found = sampling.picked(v, spark.createDataFrame([(p, counts[p], k) for p, k in alloc.items()], "period string, n long, alloc long")).collect()
        assert {(r.video_id, r.period) for r in found} == picks(rows, alloc) and len(found) == sum(alloc.values())
