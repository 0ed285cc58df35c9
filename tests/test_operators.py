"""Hand-computed cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.catalog import QUERIES
from vexel.functions import scalars, vectors
from vexel.operators import clusters, combine, diverse, frames, graph, overlap, quality, sampling
from vexel.sources import sinks, tables


def labels(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "node_id long, cluster_id long")


def one(df):
    return df.first().asDict()


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    got = df.select(vectors.cosine("a", "b").alias("c"), vectors.euclidean("a", "b").alias("e"), vectors.norm("a").alias("n")).collect()
    assert [r.c for r in got] == [0.96, None, 0.0] and got[0].n == 5 and got[0].e == pytest.approx(math.sqrt(2))
    assert [r.u for r in vectors.normalised(df, "a", "u").select("u").collect()] == [[0.6, 0.8], [None, None], [1.0, 0.0]]


def test_scalars(spark):
    at = lambda e: spark.range(1).select(e.alias("x")).first().x
    for n, k, want in ((1, 4, [0, 0, 0, 0]), (4, 1, [0]), (3, 5, [0, 0, 1, 1, 2]), (86, 36, np.linspace(0, 85, 36, dtype=int).tolist())):
        assert at(scalars.linspace(F.lit(n), F.lit(k))) == want
    assert [at(scalars.density_count(F.lit(d))) for d in (0.0, 3.9, 10.0, 59.99, 1000.0)] == [4, 4, 10, 59, 60]
    ids = ["id_1_2020-13-01x", "noid", "id_2_2020-02-30", "id_3_2021-07-09"]
    assert [at(scalars.id_date(F.lit(i)).cast("string")) for i in ids] == [None, None, None, "2021-07-09"]
    assert at(scalars.video_path("/d", F.lit("id_3_2021-07-09"))) == "/d/2021/07_July/id_3_2021-07-09.mp4"
    assert at(scalars.video_path("/d", F.lit("id_3_2021-17-09"))) == "/d/2021/17_Unknown/id_3_2021-17-09.mp4"
    assert at(scalars.safe_ratio(F.lit(1.0), F.lit(0.0))) == 0
    assert at(scalars.expected_frames(F.lit(None).cast("double"))) == -1


def test_cluster_sizes(spark):
    single = labels(spark, [3, 7, 90, 4])
    d = one(clusters.distribution(single))
    assert d["singleton_ratio"] == 100 and d["gini_coefficient"] == pytest.approx(0) and d["top10_coverage"] == 100
    d = one(clusters.distribution(labels(spark, [7, 7, 7, 3, 90, 90])))
    assert d["top1_coverage"] == 50 and d["gini_coefficient"] == pytest.approx(2 * (1 + 4 + 9) / 18 - 4 / 3)
    assert [r.cluster_id for r in clusters.top(labels(spark, [9, 9, 2, 2, 5]), 2).collect()] == [2, 9]
    assert clusters.distribution(labels(spark, [])).first().n is None
    assert clusters.needed_for(labels(spark, [1] * 8 + [2, 3])).first().clusters_needed == 1
    assert {r.n for r in clusters.histogram(spark.createDataFrame([(1.0,)] * 3, "x double"), "x", 2).collect()} == {3, 0}
    assert clusters.power_law(single).first().slope is None


def test_quality_edges(spark):
    points = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 1.0]), (2, [5.0, 0.0]), (3, [5.0, 1.0])], "node_id long, v array<double>")
    two = labels(spark, [0, 0, 1, 1]).withColumn("config", F.lit("x"))
    a, b = 1.0, (5 + math.sqrt(26)) / 2
    assert quality.silhouette(two, points).first().silhouette_score == pytest.approx((b - a) / b)
    assert quality.davies_bouldin(two, points).first().davies_bouldin_score == pytest.approx(1 / 5)
    assert quality.calinski_harabasz(two, points).first().calinski_harabasz_score == pytest.approx(25 / (1 / 2))
    same = labels(spark, [0] * 4).withColumn("config", F.lit("x"))
    m = one(quality.scored(quality.metrics(same, points)))
    assert m["silhouette_score"] is None and m["davies_bouldin_score"] is None and m["calinski_harabasz_score"] is None
    assert 0 <= m["overall_score"] <= 1


def test_overlap_edges(spark):
    a = labels(spark, [0, 0, 1, 1])
    same = one(overlap.information(a, a))
    assert same["vi_nats"] == pytest.approx(0) and same["h_a"] == pytest.approx(math.log(2)) and same["mutual_info"] == pytest.approx(math.log(2))
    other = one(overlap.information(a, labels(spark, [0, 1, 0, 1])))
    assert other["mutual_info"] == pytest.approx(0) and other["vi_bits"] == pytest.approx(2)
    classes = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, "z")], "node_id long, class string")
    p = one(overlap.purity_summary(a, classes))
    assert p["pct_clean"] == 50 and p["pct_points_clean"] == 50
    assert [r["class"] for r in overlap.never_confused(a, classes).collect()] == ["x"]


def test_graph(spark):
    v = spark.createDataFrame([(i, x) for i, x in enumerate([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [1.0, 1.0]])], "node_id long, v array<double>")
    rows = {(r.src, r.dst): r.sim for r in graph.pairwise_cosine(v, block=2).collect()}
    assert len(rows) == 10 and rows[0, 1] == 1 and rows[0, 2] == 0 and rows[1, 3] is None and rows[2, 4] == pytest.approx(math.sqrt(0.5))
    alike = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [1.0])], "node_id long, v array<double>")
    assert {r.weight for r in graph.edges(alike).collect()} == {None}
    assert graph.pairwise_cosine(v.limit(0)).collect() == []
    assert [(r.video_id, r.node_id) for r in graph.node_ids(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "video_id string")).orderBy("node_id").collect()] == [("a", 0), ("b", 1)]
    edges = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9), (3, 4, 0.95), (2, 3, 0.1)], "src long, dst long, weight double")
    lines = [r.line for r in sinks.graph_lines(edges).orderBy("src", "dst").collect()]
    assert lines[0] == "5 4" and lines[1] == "0 1 0.900000"


def test_graph_lines_of_all_vectors(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    lines = {(r.src, r.dst): r.line for r in QUERIES["graph_lines"](spark, sf).collect()}
    assert lines.pop((-1, -1)) == f"{n} {n * (n - 1) // 2}"
    weights = {(r.src, r.dst): r.weight for r in QUERIES["graph_edges"](spark, sf).collect()}
    assert lines.keys() == weights.keys() and all(x.split()[:2] == [str(i), str(j)] and abs(float(x.split()[2]) - weights[i, j]) < 2e-6 for (i, j), x in lines.items())


def test_combiners_sum_to_one(spark):
    rng = np.random.default_rng(0)
    rows = [(v, f, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for v, n in enumerate((1, 2, 3, 7)) for f in range(n)]
    df = spark.createDataFrame(rows, "video_id long, frame_idx int, embedding array<double>, logits array<double>")
    for f in (combine.diversity_weights, combine.frequency_weights, combine.confidence_weights, combine.coherence_weights):
        sums = f(df).groupBy("video_id").agg(F.sum("weight").alias("w")).collect()
        assert len(sums) == 4 and all(r.w == pytest.approx(1) for r in sums)
    for name in combine.COMBINERS:
        out = {r.video_id: r.embedding for r in combine.combine(df, name).collect()}
        assert len(out) == 4 and out[0] == pytest.approx(rows[0][2])
    with pytest.raises(ValueError):
        combine.combine(df, "none")


def test_allocation(spark):
    for target in (100, 3000):
        p = spark.createDataFrame([("a", 0), ("b", 1), ("c", 5), ("d", 1000)], "period string, n long")
        got = {r.period: r.alloc for r in sampling.allocation(p, target).collect()}
        total = min(target, 1006)
        m = max(5, total // 8)
        m = m if sum(min(m, n) for n in (0, 1, 5, 1000)) <= total else max(1, total // 4)
        rest = total - sum(min(m, n) for n in (0, 1, 5, 1000))
        assert got == {"a": 0, "b": 1, "c": 5, "d": min(min(m, 1000) + int(rest * (1000 / 1006)), 1000)}
    v = spark.createDataFrame([(f"id_{i}_2020-01-0{1 + i % 5}", float(i)) for i in range(40)], "video_id string, duration double")
    alloc = sampling.allocation(sampling.period_counts(v), 10)
    assert sampling.picked(v, alloc).count() == 10 and sampling.picked(v, alloc).agg(F.min("duration")).first()[0] >= 8
    assert sampling.trimmed(sampling.picked(v, alloc), 4, 2).count() == 4


def test_frames(spark):
    g = spark.createDataFrame([(1, [0.0] * 4), (2, [10.0, 60.0, 10.0, 60.0]), (3, None), (4, []), (5, [128.0] * 4)], "i int, g array<double>")
    assert [r.i for r in g.where(frames.good_quality(F.col("g"))).collect()] == [2]
    assert [r.h for r in g.where("i = 2").select(scalars.average_hash(F.col("g")).alias("h")).collect()] == ["0101"]
    z = {(r.i, r.k): r.z for r in frames.z_scores(g.where("i in (2, 5)"), "i", "g").collect()}
    assert z[2, 0] == -1 and z[5, 0] == 1


def test_numpy_helpers():
    flat = np.zeros((32, 32, 3), np.uint8)
    assert diverse.edge_density(flat[..., 0]) == 0 and diverse.block_variance(flat[..., 0]).tolist() == [0] * 4
    square = np.zeros((32, 32))
    square[8:24, 8:24] = 255
    assert 0 < diverse.edge_density(square) < 0.2
    assert len(diverse.picture_features(np.zeros((224, 224, 3), np.uint8))) == 293
    x = np.array([[0.0], [0.1], [5.0], [5.1]])
    assert sorted(diverse.kmeans(x, 2).ravel().round(2).tolist()) == [0.05, 5.05]


def test_embedding_failures_are_rows(spark):
    def embed(batch):
        if b"bad" in batch:
            raise ValueError("broken")
        return np.ones((len(batch), 2))

    df = spark.createDataFrame([(1, 0, bytearray(b"ok")), (1, 1, bytearray(b"bad"))], "video_id long, frame_idx int, content binary").repartition(2, "frame_idx")
    got = {r.frame_idx: (r.embedding, r.error) for r in diverse.embedded(df, embed, batch=1).collect()}
    assert got == {0: ([1.0, 1.0], None), 1: (None, "broken")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# note\n\nid_1_2020-01-01\t5.0\n  \nid_2_2020-01-02\n")
    assert [r.video_id for r in tables.id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["id_1_2020-01-01", "id_2_2020-01-02"]
    (tmp_path / "cache.json").write_text('{\n "a": 1.5,\n "b": null}')
    assert {r.video_id: r.seconds for r in tables.duration_cache(spark, str(tmp_path / "cache.json")).collect()} == {"a": 1.5, "b": None}
    for f in ("v1_frames/frame_0001.jpg", "v1_frames/frame_0000.JPG", "v1_frames/x.txt", "v2/frame_0000.png"):
        (tmp_path / "frames" / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "frames" / f).write_bytes(b"x")
    got = [(r.video_id, r.file, r.frame_idx) for r in tables.frame_files(spark, str(tmp_path / "frames")).orderBy("video_id", "frame_idx").collect()]
    assert got == [("v1", "frame_0000.JPG", 0), ("v1", "frame_0001.jpg", 1), ("v2", "frame_0000.png", 0)]
    df = spark.createDataFrame([(1, "a")], "n int, line string")
    sinks.csv(df, str(tmp_path / "csv"), one_file=True)
    sinks.json(df, str(tmp_path / "json"))
    sinks.markdown(df, str(tmp_path / "md"))
    assert tables.csv_table(spark, str(tmp_path / "csv"), "n int, line string").collect() == df.collect()
    assert tables.json_table(spark, str(tmp_path / "json"), "n int, line string").collect() == df.collect()
    assert tables.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "md")]) == str(tmp_path / "md")
    (tmp_path / "r").mkdir()
    for n in ("climate_3k_static_1fps_dinov2_vitb14_lc_temporal_coherence_labels.h5", "climate_3k_diverse_1fps_convnextv2_weighted_diversity.h5"):
        (tmp_path / "r" / n).write_bytes(b"x")
    assert sorted((r.selection, r.model, r.method) for r in tables.result_files(spark, str(tmp_path / "r" / "*.h5")).collect()) == [("diverse", "convnextv2", "weighted_diversity"), ("static", "dinov2_vitb14_lc", "temporal_coherence")]


def test_incremental_run(spark, tmp_path):
    from vexel.streaming.incremental import process_new

    schema = "video_id string, duration double, fps double, frame_count long"
    run = lambda: process_new(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), schema).awaitTermination(120)
    spark.createDataFrame([("a", 10.0, 25.0, 250), ("b", 5.0, 25.0, 125)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    spark.createDataFrame([("a", 10.0, 25.0, 250), ("c", 4.0, 25.0, 100)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert first == 15 and got.count() == 19 and got.select("video_id").distinct().count() == 3


def test_colours_by_size(spark):
    import colorsys

    from vexel.operators import clusters

    sizes = {i: 40 - i for i in range(14)} | {20: 7, 21: 6, 22: 5, 30: 4, 31: 1}
    labels = spark.createDataFrame([(n, c) for n, c in enumerate(c for c, k in sizes.items() for _ in range(k))], "node_id long, cluster_id int")
    got = {r.cluster_id: (r.category, r.colour) for r in clusters.colours(labels).collect()}
    shown = lambda *rgb: "#" + "".join(f"{int(x * 255):02x}" for x in rgb)
    for i in range(14):
        odd = i % 2
        assert got[i] == ("large", shown(*colorsys.hsv_to_rgb(i * 137.508 % 360 / 360, 0.7 if odd else 0.8, 0.9 if odd else 0.8)))
    for i, base in zip((20, 21, 22), ("#e41a1c", "#377eb8", "#4daf4a")):
        h, s, v = colorsys.rgb_to_hsv(*(int(base[j : j + 2], 16) / 255 for j in (1, 3, 5)))
        want = [int(x * 255) for x in colorsys.hsv_to_rgb(h, s * 0.4, v * 0.7)]
        assert got[i][0] == "medium" and max(abs(int(got[i][1][j : j + 2], 16) - w) for j, w in zip((1, 3, 5), want)) <= 1
    assert got[30] == got[31] == ("small", "#d3d3d3")
    one = clusters.colours(labels.where("cluster_id = 3")).first()
    assert one.colour == "#1f77b4"


def test_ranks_over_ranges(spark):
    from vexel.operators.ranking import numbered

    rows = [(g, i * 7919 % 1000, i % 5) for g in "ab" for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "g string, x int, w int"), ["x"], ["g"], "w").collect()
    sums = {g: 0 for g in "ab"}
    for r in sorted(got, key=lambda r: (r.g, r.x)):
        sums[r.g] += r.w
        assert (r["rank"], r.running) == (r.x + 1, sums[r.g])
    assert numbered(spark.createDataFrame([], "x int"), ["x"]).collect() == []


def test_silhouette_beyond_its_sample(spark):
    from vexel.operators import quality

    rng = np.random.default_rng(0)
    points = [(i, (rng.normal(0, 1, 3) + 4 * (i % 3)).tolist()) for i in range(6000)]
    labels = spark.createDataFrame([("c", i, i % 3) for i, _ in points], "config string, node_id long, cluster_id int")
    kept = quality.sampled(labels).collect()
    assert len(kept) == quality.SAMPLE == len({r.node_id for r in kept})
    order = sorted(range(6000), key=lambda i: __import__("hashlib").md5(f"{i}_42".encode()).hexdigest())
    assert {r.node_id for r in kept} == set(order[:5000])
    score = quality.silhouette(labels, spark.createDataFrame(points, "node_id long, v array<double>"), 600).first().silhouette_score
    own = order[:600]
    x, c = np.array([points[i][1] for i in own]), np.array([i % 3 for i in own])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = []
    for i in range(600):
        a = d[i][(c == c[i]) & (np.arange(600) != i)].mean()
        b = min(d[i][c == k].mean() for k in range(3) if k != c[i])
        want.append((b - a) / max(a, b))
    assert abs(score - np.mean(want)) < 1e-6
    assert quality.silhouette(labels.where("cluster_id = 1"), spark.createDataFrame(points, "node_id long, v array<double>")).first().silhouette_score is None


def test_unknown_durations_give_no_counts(spark):
    from vexel.functions import scalars

    row = spark.createDataFrame([(None, 10)], "d double, n int").select(scalars.density_count(F.col("d")), scalars.sample_rate(F.col("n"), F.col("d"), F.lit(4), F.lit(5))).first()
    assert tuple(row) == (None, None)


def test_diverse_frames_are_as_many_as_asked_for(spark):
    from vexel.operators import diverse

    rng = np.random.default_rng(1)
    rows = [(v, i, rng.normal(0, 1, 4).tolist()) for v in range(20) for i in range(9)]
    got = diverse.diverse_frames(spark.createDataFrame(rows, "video_id int, frame_idx int, embedding array<double>"), 4).groupBy("video_id").count().collect()
    assert len(got) == 20 and all(r["count"] == 4 for r in got)


def test_report_looks_at_the_largest_clusters_only(spark):
    from vexel.operators import overlap

    rows = [(i, i % 12) for i in range(12 * 30)] + [(1000 + i, 11) for i in range(5)]
    labels = spark.createDataFrame(rows, "node_id long, cluster_id int")
    assert sorted(r.a for r in overlap.report(labels, labels).collect()) == [*range(9), 11]
