"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars, vectors
from ..operators import clusters, combine, diverse, frames, graph, grid, multicut, neighbours, overlap, pictures, quality, sampling
from ..sources import fixtures as fx
from ..sources import array_files, arrays, sinks, tables, video

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

V1 = "v1 AS (SELECT vec_id AS node_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
A = "a AS (SELECT vec_id AS node_id, label::INT AS cluster_id FROM embeddings)"
B = "b AS (SELECT vec_id AS node_id, ((embedding[1] > 0)::INT * 4 + (embedding[2] > 0)::INT * 2 + (embedding[3] > 0)::INT) AS cluster_id FROM embeddings)"
SIZES = f"{A}, s AS (SELECT cluster_id, count(*) AS size FROM a GROUP BY 1), ranked AS (SELECT *, row_number() OVER (ORDER BY size DESC, cluster_id) AS rank FROM s)"
FRAMES = """f AS (SELECT vec_id // 10 AS video_id, (vec_id % 10)::INT AS frame_idx, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE NOT (vec_id BETWEEN 1 AND 9 OR vec_id BETWEEN 12 AND 19 OR vec_id BETWEEN 23 AND 29)), fn AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM f)"""
REGISTRY = """r AS (SELECT 'id_' || o_orderkey || '_' || strftime(o_orderdate, '%Y-%m-%d') AS video_id, o_totalprice / 10000 AS duration, o_orderpriority = '1-URGENT' AS duplicate,
    o_orderstatus = 'F' AS done, 25.0::DOUBLE AS fps, floor(o_totalprice / 10000 * 25)::BIGINT AS frame_count, strftime(o_orderdate, '%Y-%m') AS period FROM orders)"""
PAIRS = f"{V1}, p AS (SELECT x.node_id AS src, y.node_id AS dst, list_cosine_similarity(x.v, y.v) AS sim FROM v1 x JOIN v1 y ON x.node_id < y.node_id)"
CELLS = f"""{A}, {B}, c AS (SELECT a.cluster_id AS a, b.cluster_id AS b, count(*) AS n FROM a JOIN b USING (node_id) GROUP BY 1, 2),
    o AS (SELECT *, sum(n) OVER (PARTITION BY a) AS n_a, sum(n) OVER (PARTITION BY b) AS n_b, sum(n) OVER () AS n_all FROM c)"""
CONFIGS = f"""{V1}, {A}, {B}, l AS (SELECT 'a' AS config, * FROM a UNION ALL SELECT 'b', * FROM b), d AS (SELECT l.*, v FROM l JOIN v1 USING (node_id)),
    e AS (SELECT config, cluster_id, node_id, unnest(range(1, 65)) AS k, unnest(v) AS x FROM d),
    ck AS (SELECT config, cluster_id, k, avg(x) AS x FROM e GROUP BY ALL), cen AS (SELECT config, cluster_id, list(x ORDER BY k) AS c FROM ck GROUP BY ALL)"""
SIL = """pr AS (SELECT x.config, x.node_id, x.cluster_id AS own, y.cluster_id AS other, avg(list_distance(x.v, y.v)) AS d FROM d x JOIN d y ON x.config = y.config AND x.node_id <> y.node_id GROUP BY ALL),
    ab AS (SELECT config, node_id, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM pr GROUP BY ALL), sil AS (SELECT config, avg((b - a) / greatest(a, b)) AS silhouette_score FROM ab GROUP BY 1)"""
DB = """sp AS (SELECT config, cluster_id, avg(list_distance(v, c)) AS s FROM d JOIN cen USING (config, cluster_id) GROUP BY ALL), cs AS (SELECT * FROM cen JOIN sp USING (config, cluster_id)),
    wr AS (SELECT x.config, x.cluster_id, max((x.s + y.s) / list_distance(x.c, y.c)) AS r FROM cs x JOIN cs y ON x.config = y.config AND x.cluster_id <> y.cluster_id GROUP BY ALL), db AS (SELECT config, avg(r) AS davies_bouldin_score FROM wr GROUP BY 1)"""
CH = """gk AS (SELECT config, k, avg(x) AS x FROM e GROUP BY ALL), gc AS (SELECT config, list(x ORDER BY k) AS g FROM gk GROUP BY ALL),
    wi AS (SELECT config, cluster_id, count(*) AS m, sum(list_distance(v, c) ** 2) AS w FROM d JOIN cen USING (config, cluster_id) GROUP BY ALL),
    be AS (SELECT config, m, w, m * list_distance(c, g) ** 2 AS b FROM wi JOIN cen USING (config, cluster_id) JOIN gc USING (config)),
    ch AS (SELECT config, (sum(b) / (count(*) - 1)) / (sum(w) / (sum(m) - count(*))) AS calinski_harabasz_score FROM be GROUP BY 1)"""
DIST = """sz AS (SELECT config, cluster_id, count(*) AS size FROM l GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY size DESC, cluster_id) AS r, row_number() OVER (PARTITION BY config ORDER BY size, cluster_id) AS up FROM sz),
    di AS (SELECT config, sum(size)::BIGINT AS n, count(*) AS n_clusters, coalesce(sum(size) FILTER (r <= 10), 0) / sum(size) * 100 AS top10_coverage, 2 * sum(up * size) / (count(*) * sum(size)) - (count(*) + 1) / count(*) AS gini_coefficient,
    count(*) FILTER (size = 1) / count(*) * 100 AS singleton_ratio FROM rk GROUP BY 1)"""
SCORE = """0.3 * least(1, greatest(0, (silhouette_score + 1) / 2)) + 0.2 * least(1, greatest(0, 1 - davies_bouldin_score / 5)) + 0.1 * least(1, greatest(0, 1 - gini_coefficient)) + 0.1 * least(1, greatest(0, top10_coverage / least(10, n_clusters) / 10))
    + 0.1 * least(1, greatest(0, 1 - singleton_ratio / 100)) + 0.2 * least(1, greatest(0, ln(1 + calinski_harabasz_score) / 10))"""


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places without a negative zero, whole numbers as bigint, dates as text: as the SQL gives them."""

    def one(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        return c.alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = lambda spark, sf: rounded(f(spark, sf))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def r6(expr: str, name: str) -> str:
    return f"round(({expr})::DOUBLE, 6) + 0.0 AS {name}"


# Graph of vectors.
query("pairwise_cosine", f"WITH {PAIRS} SELECT src, dst, {r6('sim', 'sim')} FROM p")(lambda s, d: graph.pairwise_cosine(fx.video_embeddings(s, d)))
query("graph_edges", f"WITH {PAIRS} SELECT src, dst, {r6('(sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ())', 'weight')} FROM p")(lambda s, d: graph.edges(fx.video_embeddings(s, d)))
query("graph_lines", f"""WITH {PAIRS}, w AS (SELECT src, dst, (sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ()) AS w FROM p)
    SELECT -1::BIGINT AS src, -1::BIGINT AS dst, (max(dst) + 1) || ' ' || count(*) AS line FROM w UNION ALL SELECT src, dst, printf('%d %d %.6f', src, dst, w) FROM w""")(lambda s, d: sinks.graph_lines(graph.edges(fx.video_embeddings(s, d))))  # fmt: skip
query("similarity_range", f"WITH {PAIRS} SELECT {r6('min(sim)', 'min_sim')}, {r6('max(sim)', 'max_sim')}, count(*) AS n_pairs FROM p")(lambda s, d: graph.similarity_ends(fx.video_embeddings(s, d)).select(F.col("lo").alias("min_sim"), F.col("hi").alias("max_sim"), F.col("n").alias("n_pairs")))
query("similar_pairs", f"WITH {PAIRS} SELECT src, dst, {r6('sim', 'sim')} FROM p WHERE sim >= 0.3")(lambda s, d: graph.similar_pairs(fx.video_embeddings(s, d), 0.3))
query("nearest_neighbours", f"""WITH {PAIRS}, e AS (SELECT src AS id, dst AS other, sim FROM p UNION ALL SELECT dst, src, sim FROM p) SELECT id, other, {r6('sim', 'sim')} FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC) <= 15""")(
    lambda s, d: neighbours.exact(fx.video_embeddings(s, d))
)
query("node_ids", f"WITH {REGISTRY} SELECT video_id, row_number() OVER (ORDER BY video_id) - 1 AS node_id FROM r")(lambda s, d: graph.node_ids(fx.registry(s, d)))
query("norms", f"WITH {V1} SELECT node_id, {r6('sqrt(list_sum(list_transform(v, lambda x: x * x)))', 'norm')}, len(v)::BIGINT AS dims FROM v1")(lambda s, d: fx.video_embeddings(s, d).select("node_id", vectors.norm("v").alias("norm"), F.size("v").alias("dims")))


def _unit(s, d):
    rows = vectors.normalised(fx.video_embeddings(s, d), "v", "u", 1e-12)
    return rows.select("node_id", F.posexplode("u").alias("k", "x"))


query("normalised", f"WITH {V1}, u AS (SELECT node_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-12 AS n FROM v1), e AS (SELECT node_id, unnest(range(0, 64)) AS k, unnest(v) / n AS x FROM u) SELECT node_id, k::BIGINT AS k, {r6('x', 'x')} FROM e")(_unit)
query("size_histogram", f"""WITH {REGISTRY}, m AS (SELECT min(duration) AS lo, max(duration) AS hi FROM r), h AS (SELECT least(floor((duration - lo) / ((hi - lo) / 10)), 9)::BIGINT AS bin, count(*) AS n FROM r, m GROUP BY 1)
    SELECT i.bin, {r6('lo + i.bin * ((hi - lo) / 10)', 'low')}, {r6('lo + (i.bin + 1) * ((hi - lo) / 10)', 'high')}, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(0, 10)) AS bin) i CROSS JOIN m LEFT JOIN h USING (bin)""")(lambda s, d: clusters.histogram(fx.registry(s, d), "duration", 10))  # fmt: skip
query("sim_histogram", f"""WITH {PAIRS}, q AS (SELECT round(sim, 9) AS sim FROM p), m AS (SELECT min(sim) AS lo, max(sim) AS hi FROM q), h AS (SELECT least(floor((sim - lo) / ((hi - lo) / 5)), 4)::BIGINT AS bin, count(*) AS n FROM q, m GROUP BY 1)
    SELECT i.bin, {r6('lo + i.bin * ((hi - lo) / 5)', 'low')}, {r6('lo + (i.bin + 1) * ((hi - lo) / 5)', 'high')}, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(0, 5)) AS bin) i CROSS JOIN m LEFT JOIN h USING (bin)""")(
    lambda s, d: graph.similarity_histogram(fx.video_embeddings(s, d), 5)
)

# Cluster sizes.
query("cluster_sizes", f"WITH {SIZES} SELECT cluster_id::BIGINT AS cluster_id, size FROM s")(lambda s, d: clusters.sizes(fx.labels_a(s, d)))
query("cluster_ranks", f"WITH {SIZES} SELECT cluster_id::BIGINT AS cluster_id, size, rank FROM ranked")(lambda s, d: clusters.ranked(fx.labels_a(s, d)))
query("cluster_summary", f"""WITH {SIZES} SELECT sum(size)::BIGINT AS n, count(*) AS k, {r6('avg(size)', 'avg_size')}, {r6('median(size)', 'median_size')}, min(size) AS min_size, max(size) AS max_size, count(*) FILTER (size = 1) AS singletons,
    count(*) FILTER (size >= 10) AS ge10, count(*) FILTER (size >= 50) AS ge50, count(*) FILTER (size >= 100) AS ge100 FROM s""")(lambda s, d: clusters.summary(fx.labels_a(s, d)))  # fmt: skip
query("point_summary", f"""WITH {SIZES} SELECT {r6('avg(size)', 'avg_size')}, {r6('median(size)', 'median_size')}, max(size) AS max_size, min(size) AS min_size, {r6('count(*) FILTER (size = 1) / sum(size) * 100', 'pct_points_single')},
    (SELECT string_agg(size, ',' ORDER BY size DESC) FROM ranked WHERE rank <= 10) AS top10 FROM s""")(lambda s, d: clusters.point_summary(fx.labels_a(s, d)).withColumn("top10", F.array_join(F.transform("top10", lambda x: x.cast("string")), ",")))  # fmt: skip
query("cluster_distribution", f"""WITH {SIZES}, u AS (SELECT *, row_number() OVER (ORDER BY size, cluster_id) AS up FROM ranked) SELECT sum(size)::BIGINT AS n, count(*) AS k, {', '.join(r6(f'sum(size) FILTER (rank <= {t}) / sum(size) * 100', f'top{t}_coverage') for t in (1, 5, 10, 20))},
    {r6('2 * sum(up * size) / (count(*) * sum(size)) - (count(*) + 1) / count(*)', 'gini_coefficient')}, {r6('count(*) FILTER (size = 1) / count(*) * 100', 'singleton_ratio')}, {r6('max(size) / sum(size) * 100', 'mega_cluster_ratio')} FROM u""")(
    lambda s, d: clusters.distribution(fx.labels_a(s, d))
)
query("size_buckets", f"WITH {SIZES} SELECT CASE WHEN size = 1 THEN 'singleton' WHEN size < 10 THEN '2-9' WHEN size < 50 THEN '10-49' WHEN size < 100 THEN '50-99' ELSE '100+' END AS bucket, count(*) AS n_clusters, sum(size)::BIGINT AS n_points FROM s GROUP BY 1")(lambda s, d: clusters.size_buckets(fx.labels_a(s, d)))
query("size_categories", f"WITH {SIZES} SELECT cluster_id::BIGINT AS cluster_id, size, CASE WHEN size >= 50 THEN 'large' WHEN size >= 5 THEN 'medium' ELSE 'small' END AS category FROM s")(lambda s, d: clusters.categories(fx.labels_a(s, d), 50))
query("top_clusters", f"WITH {SIZES} SELECT cluster_id::BIGINT AS cluster_id, size FROM ranked WHERE rank <= 5")(lambda s, d: clusters.top(fx.labels_a(s, d), 5))
query("cluster_share", f"WITH {SIZES} SELECT cluster_id::BIGINT AS cluster_id, size, {r6('size / (SELECT sum(size) FROM s) * 100', 'share')} FROM ranked WHERE rank <= 8")(lambda s, d: clusters.shares(fx.labels_a(s, d)))
CUM = f"WITH {SIZES}, cum AS (SELECT rank, cluster_id::BIGINT AS cluster_id, size, sum(size) OVER (ORDER BY rank) / sum(size) OVER () * 100 AS coverage FROM ranked)"
query("cumulative_coverage", f"{CUM} SELECT rank, cluster_id, size, {r6('coverage', 'coverage')} FROM cum")(lambda s, d: clusters.cumulative_coverage(fx.labels_a(s, d)))
query("clusters_for_80pct", f"{CUM} SELECT min(rank) AS clusters_needed FROM cum WHERE coverage >= 80")(lambda s, d: clusters.needed_for(fx.labels_a(s, d)))
query("power_law", f"WITH {SIZES}, x AS (SELECT log10(size) AS y, log10(rank) AS x FROM ranked WHERE rank <= 20) SELECT {r6('regr_slope(y, x)', 'slope')}, {r6('regr_intercept(y, x)', 'intercept')}, {r6('regr_r2(y, x)', 'r2')} FROM x")(lambda s, d: clusters.power_law(fx.labels_a(s, d), least=2))
query("cluster_members", f"WITH {SIZES}, m AS (SELECT cluster_id, node_id, row_number() OVER (PARTITION BY cluster_id ORDER BY node_id) AS i FROM a) SELECT cluster_id::BIGINT AS cluster_id, any_value(size) AS size, string_agg('video_' || node_id, ',' ORDER BY node_id) AS members FROM m JOIN s USING (cluster_id) WHERE i <= 10 GROUP BY 1")(lambda s, d: clusters.members(fx.labels_a(s, d)))
query("non_singletons", f"WITH {SIZES} SELECT cluster_id::BIGINT AS cluster_id, node_id FROM a JOIN s USING (cluster_id) WHERE size > 1")(lambda s, d: clusters.non_singletons(fx.labels_a(s, d)))
query("box_stats", f"""WITH {SIZES}, q AS (SELECT quantile_cont(size, 0.25) AS q1, quantile_cont(size, 0.5) AS q2, quantile_cont(size, 0.75) AS q3, avg(size) AS mean FROM s)
    SELECT {r6('q1', 'q1')}, {r6('q2', 'q2')}, {r6('q3', 'q3')}, {r6('mean', 'mean')}, min(size) AS low, max(size) AS high FROM s, q WHERE size BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY q1, q2, q3, mean""")(lambda s, d: clusters.box_stats(fx.labels_a(s, d)))  # fmt: skip

# Quality.
query("centroids", f"WITH {CONFIGS} SELECT config, cluster_id::BIGINT AS cluster_id, (k - 1)::BIGINT AS k, {r6('x', 'x')} FROM ck")(lambda s, d: quality.centroids(fx.two_configs(s, d).join(fx.video_embeddings(s, d), "node_id")).select("config", "cluster_id", F.posexplode("c").alias("k", "x")))
query("silhouette", f"WITH {CONFIGS}, {SIL} SELECT config, {r6('silhouette_score', 'silhouette_score')} FROM sil")(lambda s, d: quality.silhouette(fx.two_configs(s, d), fx.video_embeddings(s, d)))
query("davies_bouldin", f"WITH {CONFIGS}, {DB} SELECT config, {r6('davies_bouldin_score', 'davies_bouldin_score')} FROM db")(lambda s, d: quality.davies_bouldin(fx.two_configs(s, d), fx.video_embeddings(s, d)))
query("calinski_harabasz", f"WITH {CONFIGS}, {CH} SELECT config, {r6('calinski_harabasz_score', 'calinski_harabasz_score')} FROM ch")(lambda s, d: quality.calinski_harabasz(fx.two_configs(s, d), fx.video_embeddings(s, d)))
ALL_METRICS = f"WITH {CONFIGS}, {SIL}, {DB}, {CH}, {DIST}, t AS (SELECT *, {SCORE} AS overall_score FROM di JOIN sil USING (config) JOIN db USING (config) JOIN ch USING (config))"
LEADER = ["config", "n_clusters", "silhouette_score", "davies_bouldin_score", "calinski_harabasz_score", "gini_coefficient", "top10_coverage", "singleton_ratio", "overall_score"]
query("leaderboard", f"{ALL_METRICS} SELECT config, n_clusters, {', '.join(r6(c, c) for c in LEADER[2:])} FROM t ORDER BY overall_score DESC, config LIMIT 10")(lambda s, d: quality.leaderboard(quality.metrics(fx.two_configs(s, d), fx.video_embeddings(s, d))).select(*LEADER))
query("overall_score", f"{ALL_METRICS} SELECT config, {r6('(silhouette_score + 1) / 2', 'quality')}, {r6('1 - gini_coefficient', 'equality')}, {r6('overall_score', 'overall_score')} FROM t")(
    lambda s, d: quality.scored(quality.metrics(fx.two_configs(s, d), fx.video_embeddings(s, d))).select("config", F.col("quality_component").alias("quality"), F.col("equality_component").alias("equality"), "overall_score")
)

# Two clusterings.
ab = lambda f: lambda s, d: f(fx.labels_a(s, d), fx.labels_b(s, d))
query("contingency", f"WITH {CELLS} SELECT a::BIGINT AS a, b::BIGINT AS b, n FROM c")(ab(overlap.contingency))
query("overlap", f"WITH {CELLS} SELECT a::BIGINT AS a, b::BIGINT AS b, n, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, {r6('n / n_a * 100', 'pct_a')}, {r6('n / n_b * 100', 'pct_b')} FROM o")(ab(overlap.overlap))
query("overlap_grid", f"""WITH {CELLS}, ta AS (SELECT cluster_id AS a, count(*) AS sa FROM a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5), tb AS (SELECT cluster_id AS b, count(*) AS sb FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
    SELECT ta.a::BIGINT AS a, tb.b::BIGINT AS b, coalesce(n, 0)::BIGINT AS n, {r6('coalesce(n, 0) / sa * 100', 'pct_a')} FROM ta CROSS JOIN tb LEFT JOIN c ON c.a = ta.a AND c.b = tb.b""")(ab(overlap.grid))  # fmt: skip
TOP10 = "a IN (SELECT cluster_id FROM a GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) AND b IN (SELECT cluster_id FROM b GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)"
query("overlap_report", f"WITH {CELLS} SELECT a::BIGINT AS a, b::BIGINT AS b, n, n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, {r6('n / n_a * 100', 'pct_a')}, {r6('n / n_b * 100', 'pct_b')} FROM o WHERE n > 10 AND {TOP10} ORDER BY n DESC, a, b LIMIT 20")(ab(overlap.report))
query("overlap_lines", f"""WITH {CELLS}, t AS (SELECT *, row_number() OVER (ORDER BY n DESC, a, b) AS i FROM o WHERE n > 10 AND {TOP10}),
    near AS (SELECT 'a_in_b' AS d, a AS x, b AS y, n, n / n_a * 100 AS pct FROM o WHERE n_a >= 5 UNION ALL SELECT 'b_in_a', b, a, n, n / n_b * 100 FROM o WHERE n_b >= 5), nr AS (SELECT *, row_number() OVER (ORDER BY d, pct DESC, x, y) AS i FROM near WHERE pct >= 15)
    SELECT i + 9 AS n, printf('| %d | %d | %d | %.1f%% | %.1f%% |', a, b, n, n / n_a * 100, n / n_b * 100) AS line FROM t WHERE i <= 20
    UNION ALL SELECT i + 99, printf('- %s: %d in %d, %d shared (%.1f%%)', d, x, y, n, pct) FROM nr WHERE i <= 20
    UNION ALL SELECT 200, printf('- %.3f nats', (SELECT -sum(n / n_all * (ln(n / n_a) + ln(n / n_b))) FROM o))
    UNION ALL SELECT 1, printf('- nodes: %d', (SELECT count(*) FROM a)) UNION ALL SELECT 2, printf('- clusters of a: %d', (SELECT count(DISTINCT cluster_id) FROM a)) UNION ALL SELECT 3, printf('- clusters of b: %d', (SELECT count(DISTINCT cluster_id) FROM b))
    UNION ALL SELECT * FROM (VALUES (0, '# Cluster overlap'), (5, '## Largest overlaps'), (6, '| a | b | shared | of a | of b |'), (7, '| --- | --- | --- | --- | --- |'), (99, '## Near-complete overlaps'), (199, '## Variation of information')) v(n, line)""")(ab(lambda a, b: overlap.report_lines(a, b, 15.0)))  # fmt: skip
query("near_complete", f"""WITH {CELLS} SELECT 'a_in_b' AS direction, a::BIGINT AS "inner", b::BIGINT AS "outer", n, {r6('n / n_a * 100', 'pct')} FROM o WHERE n_a >= 5 AND n / n_a * 100 >= 20
    UNION ALL SELECT 'b_in_a', b, a, n, round((n / n_b * 100)::DOUBLE, 6) + 0.0 FROM o WHERE n_b >= 5 AND n / n_b * 100 >= 20""")(ab(lambda a, b: overlap.near_complete(a, b, 20.0)))  # fmt: skip
query("shared_members", f"WITH {A}, {B} SELECT node_id FROM a JOIN b USING (node_id) WHERE a.cluster_id = 3 AND b.cluster_id = 5")(ab(lambda a, b: overlap.shared_members(a, b, 3, 5)))
query("entropy", f"WITH {SIZES}, p AS (SELECT size / sum(size) OVER () AS p FROM s) SELECT {r6('-sum(p * ln(p))', 'nats')}, {r6('-sum(p * log2(p))', 'bits')} FROM p")(
    lambda s, d: overlap.entropy(fx.labels_a(s, d)).select(F.col("entropy").alias("nats")).join(overlap.entropy(fx.labels_a(s, d), 2.0).select(F.col("entropy").alias("bits")))
)
P = f"WITH {CELLS}, z AS (SELECT n / n_all AS p, n_a / n_all AS pa, n_b / n_all AS pb FROM o)"
query("information", f"""{P} SELECT {r6('-sum(p * ln(pa))', 'h_a')}, {r6('-sum(p * ln(pb))', 'h_b')}, {r6('sum(p * ln(p / (pa * pb)))', 'mutual_info')}, {r6('-sum(p * ln(p / pb))', 'h_a_given_b')}, {r6('-sum(p * ln(p / pa))', 'h_b_given_a')},
    {r6('-sum(p * (ln(p / pa) + ln(p / pb)))', 'vi_nats')}, {r6('abs(sum(p * (log2(p / pa) + log2(p / pb))))', 'vi_bits')}, {r6('-sum(p * ln(p / (pb + 1e-10) + 1e-10))', 'h_a_given_b_eps')}, {r6('-sum(p * ln(p / (pa + 1e-10) + 1e-10))', 'h_b_given_a_eps')} FROM z""")(ab(overlap.information))  # fmt: skip
classes = lambda s, d: fx.labels_a(s, d).select("node_id", F.col("cluster_id").alias("class"))
CLASSED = f"WITH {CELLS}, g AS (SELECT b AS cluster_id, a AS class, n FROM c)"
query("purity", f"{CLASSED} SELECT cluster_id::BIGINT AS cluster_id, sum(n)::BIGINT AS n, count(*) AS n_classes, count(*) = 1 AS clean, {r6('max(n) / sum(n) * 100', 'pct_major')}, CASE WHEN count(*) > 1 THEN count(*) FILTER (n < 5) ELSE 0 END AS n_rare FROM g GROUP BY 1")(lambda s, d: overlap.purity(fx.labels_b(s, d), classes(s, d)))
query("minority_members", f"{CLASSED}, m AS (SELECT * FROM g WHERE n < 5 AND cluster_id IN (SELECT cluster_id FROM g GROUP BY 1 HAVING count(*) > 1)) SELECT m.cluster_id::BIGINT AS cluster_id, m.class::BIGINT AS class, any_value(m.n) AS n, string_agg(a.node_id, ',' ORDER BY a.node_id) AS members FROM m JOIN a ON a.cluster_id = m.class JOIN b ON b.node_id = a.node_id AND b.cluster_id = m.cluster_id GROUP BY 1, 2")(lambda s, d: overlap.minority_members(fx.labels_b(s, d), classes(s, d)))
query("purity_summary", f"{CLASSED}, k AS (SELECT cluster_id, sum(n) AS n, count(*) = 1 AS clean FROM g GROUP BY 1) SELECT count(*) AS k, count(*) FILTER (clean) AS clean_clusters, {r6('count(*) FILTER (clean) / count(*) * 100', 'pct_clean')}, {r6('coalesce(sum(n) FILTER (clean), 0) / sum(n) * 100', 'pct_points_clean')} FROM k")(lambda s, d: overlap.purity_summary(fx.labels_b(s, d), classes(s, d)))
query("never_confused", f"{CLASSED} SELECT DISTINCT class::BIGINT AS class FROM g WHERE class NOT IN (SELECT class FROM g WHERE cluster_id IN (SELECT cluster_id FROM g GROUP BY 1 HAVING count(*) > 1))")(lambda s, d: overlap.never_confused(fx.labels_b(s, d), classes(s, d)))

# Frames to videos.
FP = f"{FRAMES}, fp AS (SELECT x.video_id, x.frame_idx, y.frame_idx AS other, list_cosine_similarity(x.e, y.e) AS c FROM f x JOIN f y USING (video_id))"
SUM = "g AS (SELECT video_id, unnest(range(0, 64)) AS k, unnest(e) AS x, w FROM fw) SELECT video_id, k, round(sum(w * x)::DOUBLE, 6) + 0.0 AS x FROM g GROUP BY ALL"
CONF = "fc AS (SELECT *, 1 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))) AS conf FROM fn)"


def combined(method: str):
    return lambda s, d: combine.combine(fx.frame_embeddings(s, d), method).select("video_id", F.posexplode("embedding").alias("k", "x"))


query("combine_average", f"WITH {FRAMES}, fw AS (SELECT *, 1 / n AS w FROM fn), {SUM}")(combined("average"))
query("combine_diversity", f"""WITH {FP}, u AS (SELECT video_id, frame_idx, exp(stddev_pop(c) / 2) AS u FROM fp WHERE other <> frame_idx GROUP BY ALL),
    fw AS (SELECT fn.video_id, fn.e, CASE WHEN n <= 2 THEN 1 / n ELSE u / sum(u) OVER (PARTITION BY fn.video_id) END AS w FROM fn LEFT JOIN u USING (video_id, frame_idx)), {SUM}""")(combined("weighted_diversity"))  # fmt: skip
query("combine_frequency", f"""WITH {FP}, u AS (SELECT video_id, frame_idx, 1 / (count(*) FILTER (c > 0.95) + 1) AS u FROM fp GROUP BY ALL),
    fw AS (SELECT fn.video_id, fn.e, CASE WHEN n <= 2 THEN 1 / n ELSE u / sum(u) OVER (PARTITION BY fn.video_id) END AS w FROM fn JOIN u USING (video_id, frame_idx)), {SUM}""")(combined("weighted_frequency"))  # fmt: skip
query("combine_max_confidence", f"WITH {FRAMES}, {CONF}, fw AS (SELECT video_id, e, 1 AS w FROM fc QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY conf DESC, frame_idx) = 1), {SUM}")(combined("max_confidence"))
query("combine_weighted_confidence", f"WITH {FRAMES}, {CONF}, fw AS (SELECT video_id, e, exp(conf / 2) / sum(exp(conf / 2)) OVER (PARTITION BY video_id) AS w FROM fc), {SUM}")(combined("weighted_confidence"))
query("combine_temporal", f"""WITH {FP}, u AS (SELECT video_id, frame_idx, avg(c) AS u FROM fp WHERE abs(other - frame_idx) = 1 GROUP BY ALL),
    fw AS (SELECT fn.video_id, fn.e, CASE WHEN n <= 3 THEN 1 / n ELSE exp(coalesce(u, 0) * 2) / sum(exp(coalesce(u, 0) * 2)) OVER (PARTITION BY fn.video_id) END AS w FROM fn LEFT JOIN u USING (video_id, frame_idx)), {SUM}""")(combined("temporal_coherence"))  # fmt: skip
query("combine_uniform", f"""WITH {FRAMES}, i AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS i FROM fn), t AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS m FROM i WHERE n <= 4 OR list_contains([0, floor(1 * ((n - 1) / 3)), floor(2 * ((n - 1) / 3)), n - 1], i)),
    fw AS (SELECT *, 1 / m AS w FROM t), {SUM}""")(combined("uniform_temporal"))  # fmt: skip
query("combine_temporal_gaps", f"""WITH {FRAMES}, h AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS i, count(*) OVER (PARTITION BY video_id) AS m FROM f WHERE frame_idx % 3 <> 1),
    u AS (SELECT x.video_id, x.frame_idx, avg(list_cosine_similarity(x.e, y.e)) AS u FROM h x JOIN h y ON x.video_id = y.video_id AND abs(x.i - y.i) = 1 GROUP BY ALL),
    fw AS (SELECT h.video_id, h.e, CASE WHEN m <= 3 THEN 1 / m ELSE exp(coalesce(u, 0) * 2) / sum(exp(coalesce(u, 0) * 2)) OVER (PARTITION BY h.video_id) END AS w FROM h LEFT JOIN u USING (video_id, frame_idx)), {SUM}""")(
    lambda s, d: combine.combine(fx.frame_embeddings(s, d).withColumn("embedding", F.when(F.col("frame_idx") % 3 != 1, F.col("embedding"))), "temporal_coherence").select("video_id", F.posexplode("embedding").alias("k", "x"))
)
query("video_status", f"""WITH {FRAMES}, x AS (SELECT video_id, count(*) AS n, count(*) FILTER (frame_idx % 4 <> 3 AND video_id <> 7) AS ok, string_agg(frame_idx, ',' ORDER BY frame_idx) FILTER ((frame_idx % 4 = 3 OR video_id = 7) AND frame_idx < CASE WHEN video_id = 7 THEN 3 ELSE 99 END) AS bad FROM f WHERE video_id <> 5 GROUP BY 1)
    SELECT v.video_id, coalesce(n, 0)::BIGINT AS n_frames, coalesce(ok, 0)::BIGINT AS n_embedded, CASE WHEN n IS NULL THEN 'no frames' WHEN ok = 0 THEN 'all frames failed' WHEN ok < n THEN 'some frames failed' ELSE 'ok' END AS status, coalesce(bad, '') AS failed_frames FROM (SELECT DISTINCT video_id FROM f) v LEFT JOIN x USING (video_id)""")(
    lambda s, d: combine.video_status(fx.frame_embeddings(s, d).select("video_id").distinct(), fx.frame_embeddings(s, d).where("video_id <> 5").withColumn("embedding", F.when((F.col("frame_idx") % 4 != 3) & (F.col("video_id") != 7), F.col("embedding"))))
)

# Sampling.
corpus = fx.registry
dups = lambda s, d: fx.registry(s, d).where("duplicate")
valid = lambda s, d: sampling.long_enough(fx.registry(s, d))
VALID = f"{REGISTRY}, v AS (SELECT * FROM r WHERE duration >= 5)"
query("dedupe_ids", f"WITH {REGISTRY} SELECT DISTINCT video_id FROM r WHERE NOT duplicate")(lambda s, d: sampling.unique_ids(corpus(s, d), dups(s, d)))
query("registry_counts", f"WITH {REGISTRY} SELECT count(*) AS total, count(*) FILTER (duplicate) AS duplicates, count(*) FILTER (NOT duplicate) AS unique_ids FROM r")(lambda s, d: sampling.registry_counts(corpus(s, d), dups(s, d)))
query("parse_ids", f"WITH {REGISTRY} SELECT video_id, split_part(video_id, '_', 3) AS date, split_part(period, '-', 1)::BIGINT AS year, split_part(period, '-', 2)::BIGINT AS month, right(video_id, 2)::BIGINT AS day FROM r")(lambda s, d: sampling.parsed(corpus(s, d).select("video_id")))
query("duration_filter", f"WITH {REGISTRY} SELECT video_id, {r6('duration', 'duration')} FROM r WHERE duration >= 5")(lambda s, d: valid(s, d).select("video_id", "duration"))
query("status_counts", f"WITH {REGISTRY} SELECT CASE WHEN duration < 5 THEN 'filtered' ELSE 'valid' END AS status, count(*) AS n, {r6('count(*) / (SELECT count(*) FROM r) * 100', 'pct')} FROM r GROUP BY 1")(lambda s, d: sampling.success_counts(corpus(s, d)))
query("period_counts", f"WITH {REGISTRY} SELECT period, count(*) AS n FROM r GROUP BY 1")(lambda s, d: sampling.period_counts(corpus(s, d)))
query("period_validity", f"WITH {REGISTRY} SELECT period, count(*) AS total, count(*) FILTER (duration >= 5) AS valid, {r6('count(*) FILTER (duration >= 5) / count(*) * 100', 'pct_valid')} FROM r GROUP BY 1")(lambda s, d: sampling.period_validity(corpus(s, d)))
ALLOC = f"""{VALID}, pc AS (SELECT period, count(*) AS n FROM v GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS nn, count(*) OVER () AS pp, least(3000, sum(n) OVER ())::BIGINT AS tt FROM pc), m1 AS (SELECT *, greatest(5, tt // (2 * pp)) AS m FROM t),
    m2 AS (SELECT * EXCLUDE (m), CASE WHEN sum(least(m, n)) OVER () > tt THEN greatest(1, tt // pp) ELSE m END AS m FROM m1), rr AS (SELECT *, tt - sum(least(m, n)) OVER () AS rest FROM m2),
    al AS (SELECT period, n, (CASE WHEN rest > 0 AND n > m THEN least(least(m, n) + floor(rest::DOUBLE * (n::DOUBLE / nn)), n) ELSE least(m, n) END)::BIGINT AS alloc FROM rr)"""
alloc = lambda s, d: sampling.allocation(sampling.period_counts(valid(s, d)), 3000)
query("allocation", f"WITH {ALLOC} SELECT * FROM al")(alloc)
PICK = f"""{ALLOC}, q AS (SELECT v.video_id, v.period, v.duration, n, alloc, row_number() OVER (PARTITION BY v.period ORDER BY duration DESC, video_id) <= floor(n * 0.8::DOUBLE) AS lg FROM v JOIN al USING (period)),
    pk AS (SELECT video_id, period, duration FROM q QUALIFY row_number() OVER (PARTITION BY period ORDER BY CASE WHEN n > alloc THEN lg ELSE true END DESC, md5(video_id || '_42'), video_id) <= alloc)"""
sample = lambda s, d: sampling.picked(valid(s, d), alloc(s, d))
query("sample_pick", f"WITH {PICK} SELECT video_id, period, {r6('duration', 'duration')} FROM pk")(sample)
query("sample_trim", f"""WITH {PICK}, sz AS (SELECT period, count(*) AS n, greatest(count(*) - 20, 0) AS can FROM pk GROUP BY 1), ct AS (SELECT period, greatest(0, least(can, (SELECT greatest(count(*) - 1500, 0) FROM pk) - coalesce(sum(can) OVER (ORDER BY n DESC, period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS cut FROM sz)
    SELECT video_id, period, {r6('duration', 'duration')} FROM pk JOIN ct USING (period) QUALIFY row_number() OVER (PARTITION BY period ORDER BY duration, video_id) > cut""")(lambda s, d: sampling.trimmed(sample(s, d), 1500, 20).select("video_id", "period", "duration"))  # fmt: skip
query("sample_table", f"WITH {VALID} SELECT video_id, split_part(period, '-', 1) AS year, (split_part(period, '-', 2)::INT)::VARCHAR AS month, (right(video_id, 2)::INT)::VARCHAR AS day, split_part(video_id, '_', 3) AS date, {r6('duration', 'duration_seconds')}, floor(duration)::BIGINT AS expected_frames FROM v")(lambda s, d: sampling.sample_table(valid(s, d)))
query("sample_stats", f"WITH {VALID} SELECT count(*) AS n, {r6('avg(duration)', 'mean')}, {r6('median(duration)', 'median')}, {r6('stddev_pop(duration)', 'std')}, {r6('min(duration)', 'min')}, {r6('max(duration)', 'max')}, {r6('sum(duration) / 3600', 'hours')}, sum(floor(duration))::BIGINT AS expected_frames FROM v")(lambda s, d: sampling.duration_stats(valid(s, d)))
query("period_stats", f"""WITH {VALID}, i AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY video_id) AS i, count(*) OVER (PARTITION BY period) AS n FROM v)
    SELECT period, any_value(n) AS n, {r6('avg(duration)', 'mean_duration')}, round((sum(duration) / 3600)::DOUBLE, 4) + 0.0 AS hours, string_agg(video_id, ',' ORDER BY video_id) FILTER (i <= 3) || CASE WHEN any_value(n) > 3 THEN '...' ELSE '' END AS sample_ids FROM i GROUP BY 1""")(lambda s, d: sampling.period_stats(valid(s, d)).withColumn("hours", F.round("hours", 4)))  # fmt: skip
query("period_balance", f"WITH {VALID}, c AS (SELECT count(*) AS n FROM v GROUP BY period) SELECT count(*) AS n_periods, {r6('avg(n)', 'mean_per_period')}, {r6('stddev_pop(n)', 'std_per_period')} FROM c")(lambda s, d: sampling.period_balance(valid(s, d)))
query("duration_buckets", f"WITH {REGISTRY} SELECT count(*) FILTER (duration >= 5 AND duration < 10) AS d5_10, count(*) FILTER (duration >= 10 AND duration < 30) AS d10_30, count(*) FILTER (duration >= 30 AND duration < 60) AS d30_60, count(*) FILTER (duration >= 60) AS d60 FROM r")(lambda s, d: sampling.duration_buckets(corpus(s, d)))
query("path_resolve", f"WITH {REGISTRY} SELECT video_id, '/data/' || split_part(period, '-', 1) || '/' || strftime((split_part(video_id, '_', 3))::DATE, '%m_%B') || '/' || video_id || '.mp4' AS path FROM r")(lambda s, d: corpus(s, d).select("video_id", scalars.video_path("/data", F.col("video_id")).alias("path")))
query("duration_default", f"WITH {REGISTRY} SELECT video_id, {r6('CASE WHEN done THEN duration ELSE 5 END', 'duration')} FROM r")(lambda s, d: sampling.with_durations(corpus(s, d).select("video_id"), corpus(s, d).where("done").select("video_id", F.col("duration").alias("seconds"))))
query("stratified_cap", f"""WITH {A}, q AS (SELECT node_id, cluster_id FROM a QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY md5(node_id || '_42'), node_id) <= greatest(1, 120 // (SELECT count(DISTINCT cluster_id) FROM a)))
    SELECT node_id, cluster_id::BIGINT AS cluster_id FROM q ORDER BY md5(node_id || '_42'), node_id LIMIT 120""")(lambda s, d: sampling.capped(fx.labels_a(s, d), 120))  # fmt: skip
query("cluster_samples", f"WITH {SIZES} SELECT cluster_id::BIGINT AS cluster_id, node_id FROM a WHERE cluster_id IN (SELECT cluster_id FROM ranked WHERE rank <= 10) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY md5(node_id || '_42'), node_id) <= 10")(lambda s, d: sampling.cluster_samples(fx.labels_a(s, d)))
query("common_ids", f"WITH {REGISTRY} SELECT video_id, period FROM r WHERE duplicate")(lambda s, d: sampling.common_ids(corpus(s, d).select("video_id", scalars.period(scalars.id_date(F.col("video_id"))).alias("period")), dups(s, d)))
query("stratified_cap_all", f"WITH {A} SELECT node_id, cluster_id::BIGINT AS cluster_id FROM a WHERE node_id < 400 OR cluster_id = 1")(lambda s, d: sampling.capped(fx.labels_a(s, d).where("node_id < 400 OR cluster_id = 1"), 1_000_000))
query("projected_centroids", f"WITH {V1}, {A} SELECT cluster_id::BIGINT AS cluster_id, {r6('avg(v[1])', 'x')}, {r6('avg(v[2])', 'y')}, count(*) AS n FROM v1 JOIN a USING (node_id) GROUP BY 1")(lambda s, d: diverse.projected_centroids(fx.video_embeddings(s, d).select("node_id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")), fx.labels_a(s, d)))
GRID = f"""{FRAMES}, sel AS (SELECT 'static' AS selection, video_id, frame_idx, e FROM f UNION ALL SELECT 'diverse', video_id, frame_idx, e FROM f WHERE frame_idx % 2 = 0),
    gf AS (SELECT 'convnextv2' AS model, *, e AS lg FROM sel UNION ALL SELECT 'dinov2', selection, video_id, frame_idx, list_reverse(e), e FROM sel),
    gn AS (SELECT *, count(*) OVER k AS n, row_number() OVER (k ORDER BY frame_idx) AS i, 1 / list_sum(list_transform(lg, lambda x: exp(x - list_max(lg)))) AS conf FROM gf WINDOW k AS (PARTITION BY model, selection, video_id)),
    gp AS (SELECT x.model, x.selection, x.video_id, x.frame_idx, stddev_pop(list_cosine_similarity(x.e, y.e)) AS sd, avg(list_cosine_similarity(x.e, y.e)) FILTER (abs(x.i - y.i) = 1) AS near FROM gn x JOIN gn y ON x.model = y.model AND x.selection = y.selection AND x.video_id = y.video_id AND x.i <> y.i GROUP BY ALL),
    ge AS (SELECT gn.*, CASE WHEN n <= 2 THEN 1 ELSE exp(sd / 2) END AS wd, exp(conf / 2) AS wc, CASE WHEN n <= 3 THEN 1 ELSE exp(coalesce(near, 0) * 2) END AS wt, CASE WHEN row_number() OVER (PARTITION BY gn.model, gn.selection, gn.video_id ORDER BY conf DESC, gn.frame_idx) = 1 THEN 1 ELSE 0 END AS wm FROM gn LEFT JOIN gp USING (model, selection, video_id, frame_idx)),
    gw AS ({' UNION ALL '.join(f"SELECT model, selection, '{name}' AS method, video_id, e, {w} AS w FROM ge WHERE model = '{m}'" for m, names in grid.METHODS.items() for name, w in {"average": "1", "weighted_diversity": "wd", "max_confidence": "wm", "weighted_confidence": "wc", "temporal_coherence": "wt"}.items() if name in names)}),
    gx AS (SELECT model, selection, method, video_id, k, sum(w * x) / sum(w) AS x FROM (SELECT model, selection, method, video_id, w, unnest(range(1, 65)) AS k, unnest(e) AS x FROM gw) GROUP BY ALL),
    gv AS (SELECT model, selection, method, 'climate_3k_' || selection || '_1fps_' || model || CASE WHEN model = 'dinov2' THEN '_vitb14_lc' ELSE '' END || '_' || method AS config, video_id AS node_id, list(x ORDER BY k) AS v FROM gx GROUP BY ALL)"""
query("config_names", f"WITH {GRID} SELECT selection, model, method, config, replace(replace(config, '1fps_dinov2_vitb14_lc', 'dinov2'), '1fps_convnextv2', 'convnextv2') AS short_name, count(*) AS n_videos FROM gv GROUP BY ALL")(
    lambda s, d: grid.configurations(grid.video_vectors(fx.grid_frames(s, d)))
)
query("strategy_texts", f"WITH {GRID}, t AS (SELECT selection, count(DISTINCT video_id) / 10 AS fps FROM gf GROUP BY 1) SELECT selection, CASE selection WHEN 'static' THEN 'Uniformly spaced frames at ' ELSE 'Visually diverse frames selected at ' END || fps || ' fps density' AS description FROM t")(
    lambda s, d: fx.grid_frames(s, d).groupBy("selection").agg((F.count_distinct("video_id") / 10).alias("fps")).select("selection", grid.strategy_text(F.col("selection"), F.col("fps")).alias("description"))
)
GRID_METRICS = f"""WITH {GRID}, l AS (SELECT config, node_id, (v[1] > 0)::INT * 4 + (v[2] > 0)::INT * 2 + (v[3] > 0)::INT AS cluster_id FROM gv),
    d AS (SELECT l.*, v FROM l JOIN gv USING (config, node_id) QUALIFY count(*) OVER (PARTITION BY config, cluster_id) > 1), e AS (SELECT config, cluster_id, node_id, unnest(range(1, 65)) AS k, unnest(v) AS x FROM d),
    ck AS (SELECT config, cluster_id, k, avg(x) AS x FROM e GROUP BY ALL), cen AS (SELECT config, cluster_id, list(x ORDER BY k) AS c FROM ck GROUP BY ALL), {SIL}, {DB}, {CH}, {DIST},
    t AS (SELECT *, {SCORE} AS overall_score FROM di JOIN sil USING (config) JOIN db USING (config) JOIN ch USING (config) JOIN (SELECT DISTINCT config, selection, model, method FROM gv) USING (config))"""
GRID_COLUMNS = ["silhouette_score", "davies_bouldin_score", "calinski_harabasz_score", "gini_coefficient", "top10_coverage", "singleton_ratio", "overall_score"]


def _grid(s, d):
    v = grid.video_vectors(fx.grid_frames(s, d))
    return grid.scores(fx.grid_labels(v), v).select("selection", "model", "method", "config", "n_clusters", *GRID_COLUMNS)


query("metric_grid", f"{GRID_METRICS} SELECT selection, model, method, config, n_clusters, {', '.join(r6(c, c) for c in GRID_COLUMNS)} FROM t")(_grid)

# Frames.
K = "greatest(4, least(60, floor(duration)))::BIGINT"
query("density_count", f"WITH {REGISTRY} SELECT video_id, {K} AS n_frames FROM r")(lambda s, d: corpus(s, d).select("video_id", scalars.density_count(F.col("duration")).alias("n_frames")))
query("sample_rate", f"""WITH {REGISTRY}, k AS (SELECT *, {K} AS k, 5 AS rate FROM r), n AS (SELECT *, greatest(3 * k, floor(2 * duration)::BIGINT) AS need FROM k)
    SELECT video_id, (CASE WHEN frame_count < need * rate THEN greatest(1, frame_count // need) ELSE rate END)::BIGINT AS rate FROM n""")(lambda s, d: corpus(s, d).select("video_id", scalars.sample_rate(F.col("frame_count"), F.col("duration"), scalars.density_count(F.col("duration")), F.lit(5)).alias("rate")))  # fmt: skip
query("static_frames", f"""WITH {REGISTRY}, k AS (SELECT *, {K} AS k FROM r WHERE frame_count > 0), i AS (SELECT *, unnest(range(0, k)) AS position FROM k)
    SELECT video_id, position, idx AS index, {r6('idx / fps', 'timestamp')} FROM (SELECT *, (CASE WHEN position = k - 1 THEN frame_count - 1 ELSE floor(position * ((frame_count - 1)::DOUBLE / (k - 1))) END)::BIGINT AS idx FROM i)""")(lambda s, d: frames.static_frames(corpus(s, d)))  # fmt: skip
query("skip_done", f"WITH {REGISTRY} SELECT video_id FROM r WHERE NOT done")(lambda s, d: frames.pending(corpus(s, d).select("video_id"), corpus(s, d).where("done").select("video_id", F.lit("density-based").alias("sampling_method"))))
query("split_filter", f"WITH {REGISTRY} SELECT video_id FROM r WHERE duplicate")(lambda s, d: frames.split(corpus(s, d).select("video_id"), dups(s, d)))
query("extraction_stats", f"WITH {REGISTRY}, k AS (SELECT duration, {K} AS frames FROM r) SELECT count(*) AS n, {r6('avg(duration)', 'mean_duration')}, {r6('median(duration)', 'median_duration')}, {r6('min(duration)', 'min_duration')}, {r6('max(duration)', 'max_duration')}, {r6('avg(frames)', 'mean_frames')}, {r6('median(frames)', 'median_frames')}, {r6('avg(frames / duration)', 'mean_density')} FROM k")(
    lambda s, d: frames.extraction_stats(corpus(s, d).select("duration", scalars.density_count(F.col("duration")).alias("frames")))
)
GRAY = f"{V1}, g AS (SELECT node_id, list_transform(v, lambda x: floor(least(greatest((x + 1) * 127.5, 0), 255))::DOUBLE) AS g FROM v1)"
query("frame_quality", f"WITH {GRAY}, q AS (SELECT node_id, list_avg(g) AS m, list_stddev_pop(g) AS s FROM g) SELECT node_id, {r6('m', 'mean')}, {r6('s', 'std')} FROM q WHERE m BETWEEN 5 AND 250 AND s > 15.9")(
    lambda s, d: fx.thumbnails(s, d).where(frames.good_quality(F.col("g"), 15.9)).select("node_id", vectors.mean("g").alias("mean"), vectors.std_pop("g").alias("std"))
)
query("average_hash", f"WITH {GRAY}, q AS (SELECT node_id, g, list_avg(g) AS m FROM g) SELECT node_id, array_to_string(list_transform(g, lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), '') AS hash FROM q")(lambda s, d: frames.hashed(fx.thumbnails(s, d)).select("node_id", "hash"))
query("zscore_features", f"WITH {V1}, e AS (SELECT node_id, unnest(range(0, 64)) AS k, unnest(v) AS x FROM v1) SELECT node_id, k, {r6('(x - avg(x) OVER (PARTITION BY k)) / stddev_pop(x) OVER (PARTITION BY k)', 'z')} FROM e")(lambda s, d: frames.z_scores(fx.video_embeddings(s, d), "node_id"))
query("confidence", f"WITH {FRAMES}, {CONF} SELECT video_id, frame_idx::BIGINT AS frame_idx, {r6('conf', 'confidence')} FROM fc")(lambda s, d: fx.frame_embeddings(s, d).select("video_id", "frame_idx", vectors.top_softmax("logits").alias("confidence")))
query("shown_ids", f"WITH {REGISTRY} SELECT video_id, CASE WHEN length(video_id) > 15 THEN left(video_id, 15) || '...' || split_part(video_id, '_', 3) ELSE video_id END AS shown FROM r")(lambda s, d: corpus(s, d).select("video_id", scalars.shown_id(F.col("video_id"), 15).alias("shown")))

COLOURS = "['" + "', '".join(scalars.PALETTE) + "']"
query("cluster_colours", f"""WITH {SIZES}, c AS (SELECT *, CASE WHEN size >= 10 THEN 'large' WHEN size >= 5 THEN 'medium' ELSE 'small' END AS category FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY size DESC, cluster_id) - 1 AS i, count(*) OVER (PARTITION BY category) AS k FROM c),
    t AS (SELECT *, (i * 137.508::DOUBLE) % 360 / 60 AS h, CASE WHEN i % 2 = 0 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS sat, CASE WHEN i % 2 = 0 THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS val FROM k), q AS (SELECT *, floor(h)::INT AS z, h - floor(h) AS f FROM t),
    w AS (SELECT *, val * (1 - sat) AS p, val * (1 - sat * f) AS q, val * (1 - sat * (1 - f)) AS t FROM q), x AS (SELECT *, [val, q, p, p, t, val][z + 1] AS r, [t, val, val, q, p, p][z + 1] AS g, [p, p, t, val, val, q][z + 1] AS b FROM w)
    SELECT cluster_id::BIGINT AS cluster_id, size, category, CASE WHEN k = 1 THEN '#1f77b4' WHEN k <= 12 THEN {COLOURS}[i + 1] ELSE printf('#%02x%02x%02x', floor(r * 255)::INT, floor(g * 255)::INT, floor(b * 255)::INT) END AS colour FROM x""")(
    lambda s, d: clusters.colours(fx.labels_a(s, d))
)

def _mapped(s, d):
    v = fx.video_embeddings(s, d).select(F.concat(F.lit("video_"), F.col("node_id").cast("string")).alias("video_id"), "v")
    return graph.mapped_pairs(v, graph.node_ids(v.select("video_id")), 0.3)


query("id_list", "SELECT 'id_' || o_orderkey AS video_id FROM orders WHERE o_orderkey % 5 <> 0")(
    lambda s, d: tables.ids_of_lines(tables.table(s, d, "orders").select(F.explode(F.array(F.concat(F.when(F.col("o_orderkey") % 5 == 0, "# ").otherwise(""), F.lit(" id_"), "o_orderkey", F.lit("\t"), "o_totalprice"), F.lit("  "), F.lit(""))).alias("value")))
)
query("duration_cache", f"WITH {REGISTRY} SELECT video_id, CASE WHEN done THEN {r6('duration', 'x').split(' AS ')[0]} END AS seconds FROM r")(
    # One object for each customer's orders.
    lambda s, d: tables.durations_of_text(
        corpus(s, d).groupBy(F.xxhash64("video_id") % 500).agg(F.concat(F.lit("{\n"), F.array_join(F.collect_list(F.concat(F.lit('"'), "video_id", F.lit('": '), F.when(F.col("done"), F.col("duration").cast("string")).otherwise("null"))), ",\n"), F.lit("}")).alias("value"))
    )
)
query("result_names", f"WITH {GRID} SELECT DISTINCT config || '_clusters.h5' AS file, selection, CASE WHEN model = 'dinov2' THEN 'dinov2_vitb14_lc' ELSE model END AS model, method FROM gv")(
    lambda s, d: (lambda v: v.select("file", *[c.alias(n) for n, c in tables.name_parts(F.col("file")).items()]))(grid.video_vectors(fx.grid_frames(s, d)).select(F.concat("config", F.lit("_clusters.h5")).alias("file")).distinct())
)
query("mapped_edges", f"""WITH {PAIRS}, i AS (SELECT 'video_' || node_id AS video_id, row_number() OVER (ORDER BY 'video_' || node_id) - 1 AS n FROM v1)
    SELECT least(a.n, b.n) AS src, greatest(a.n, b.n) AS dst, {r6('sim', 'sim')} FROM p JOIN i a ON a.video_id = 'video_' || src JOIN i b ON b.video_id = 'video_' || dst WHERE sim >= 0.3""")(_mapped)
query("hdf5_labels", f"WITH {A} SELECT node_id, cluster_id::BIGINT AS label FROM a")(lambda s, d: arrays.labels_in(array_files.label_files(fx.labels_a(s, d), rows=200, chunk=30), "file").select((F.col("file").cast("long") * 200 + F.col("node_id")).alias("node_id"), "label"))
query("tensor_vectors", "SELECT vec_id::VARCHAR AS key, (k - 1)::BIGINT AS k, " + r6("x", "x") + " FROM (SELECT vec_id, unnest(range(1, 65)) AS k, unnest(embedding) AS x FROM embeddings)")(
    lambda s, d: arrays.tensors_in(array_files.tensor_files(fx.video_embeddings(s, d)), "file").select("key", F.posexplode("v").alias("k", "x"))
)
query("video_probe", f"""WITH {REGISTRY}, i AS (SELECT *, split_part(video_id, '_', 2)::BIGINT AS i FROM r), x AS (SELECT *, CASE WHEN i % 7 = 0 THEN 'moov cut off' WHEN i % 11 = 0 THEN 'no video track' END AS reason FROM i)
    SELECT video_id, CASE WHEN reason IS NULL THEN CASE WHEN frame_count > 0 THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END END AS fps, CASE WHEN reason IS NULL THEN frame_count END AS frame_count, CASE WHEN reason IS NULL THEN {r6('frame_count / 25', 'x').split(' AS ')[0]} END AS duration, reason FROM x""")(
    lambda s, d: video.probed(fx.inline_videos(s, d))
)


def _kept(s, d):
    chosen = frames.static_frames(fx.picture_videos(s, d))
    gray = fx.frame_embeddings(s, d).select("video_id", F.col("frame_idx").cast("long").alias("index"), F.transform("embedding", lambda x: F.floor(F.least(F.greatest((x + 1) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("double")).alias("g"))
    return frames.kept_frames(chosen, gray, 15.9)


def _over_white(s, d):
    level = lambda x: F.lpad(F.hex(F.floor(F.least(F.greatest((x * 3 + 1) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("long")), 2, "0")
    data = F.unhex(F.array_join(F.transform("embedding", lambda x: F.concat(level(x), level(-x), F.lit("C8"), level(2 * x))), ""))
    rows = fx.frame_embeddings(s, d).select("video_id", "frame_idx", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(4).alias("channels"), data.alias("data"))
    return pictures.composited(rows).select("video_id", "frame_idx", "channels", F.hex("data").alias("pixels"))


LEVEL = "floor(least(greatest(({} * 3 + 1) * 127.5, 0), 255))::BIGINT"
OVER = f"(({{}}) * {LEVEL.format('2 * x')} + 255 * (255 - {LEVEL.format('2 * x')}) + 127) // 255"
query("alpha_on_white", f"""WITH {FRAMES} SELECT video_id, frame_idx::BIGINT AS frame_idx, 3::BIGINT AS channels,
    array_to_string(list_transform(e, lambda x: printf('%02X%02X%02X', {OVER.format(LEVEL.format('x'))}, {OVER.format(LEVEL.format('(-x)'))}, {OVER.format('200')})), '') AS pixels FROM f""")(_over_white)

query("kept_frames", f"""WITH {FRAMES}, v AS (SELECT video_id, count(*) AS frame_count, count(*) / 5 + CASE WHEN video_id % 3 = 0 THEN 5 ELSE 0 END AS duration FROM f GROUP BY 1), k AS (SELECT *, greatest(4, least(60, floor(duration)))::BIGINT AS k FROM v),
    i AS (SELECT *, unnest(range(0, k)) AS p FROM k), x AS (SELECT *, (CASE WHEN p = k - 1 THEN frame_count - 1 ELSE floor(p * ((frame_count - 1)::DOUBLE / (k - 1))) END)::BIGINT AS index FROM i),
    g AS (SELECT video_id, frame_idx, list_transform(e, lambda x: floor(least(greatest((x + 1) * 127.5, 0), 255))::DOUBLE) AS g FROM f), good AS (SELECT video_id, frame_idx AS index FROM g WHERE list_avg(g) BETWEEN 5 AND 250 AND list_stddev_pop(g) > 15.9)
    SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY p) - 1 AS position, index, {r6('index / 5', 'timestamp')} FROM x JOIN good USING (video_id, index)""")(_kept)

# Without an SQL form: numerical iterations.
query("diverse_frames")(lambda s, d: diverse.diverse_frames(fx.frame_embeddings(s, d)))
query("project_2d")(lambda s, d: diverse.projected(fx.video_embeddings(s, d)))
query("diverse_selection")(lambda s, d: pictures.diverse_selection(fx.picture_videos(s, d), fx.pictures(s, d), rate=2))
query("neighbour_layout")(lambda s, d: neighbours.projected(fx.video_embeddings(s, d)))
query("multicut")(lambda s, d: multicut.multicut(multicut.signed(neighbours.nearest(fx.video_embeddings(s, d), 8).select(F.col("id").alias("src"), F.col("other").alias("dst"), F.col("sim").alias("weight")), 0.35)))
query("exponential_fit")(lambda s, d: diverse.exponential_fit(clusters.ranked(fx.two_configs(s, d), ["config"]).select("config", F.col("rank").alias("x"), F.col("size").cast("double").alias("y")), "config"))
