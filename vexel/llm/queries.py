"""The queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontam, html, ngram_lm, quality, simhash, spelling, suffix, toxicity, warc, wavelet, winnow
from .common import table


def tokenizer_path() -> str:
    """The vocabulary file of the public 50k byte-level BPE, where the tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removals(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.stored_ids(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_lm.scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("score", "mean_score")])


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_array": op2_suffix_array,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_simhash": op5_simhash,
    "op6_wavelet": op6_wavelet,
    "op7_html": op7_html,
    "op8_winnowing": op8_winnowing,
    "op9_toxicity": op9_toxicity,
    "op10_stupid_backoff": op10_stupid_backoff,
    "op11_spelling": op11_spelling,
    "op12_centroids": op12_centroids,
    "op13_warc": op13_warc,
}

FITS = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _round(i: int) -> str:
    """Assignment to the centroids c<i> as a<i>, and the next centroids."""
    gap = "list_sum(list_transform(list_zip(k.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    return f"""a{i} AS (SELECT * FROM (SELECT k.r, k.vec_id, k.q, c.c, {gap} AS d FROM k CROSS JOIN c{i} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),
        m{i} AS (SELECT c, j, floor(sum(q[j]) / count(*))::BIGINT AS x FROM (SELECT c, q, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY ALL),
        c{i + 1} AS (SELECT c, coalesce(n.q, o.q) AS q FROM c{i} o LEFT JOIN (SELECT c, list(x ORDER BY j) AS q FROM m{i} GROUP BY 1) n USING (c))"""


def _base32(hex_: str) -> str:
    """Twenty bits, five hex digits, at a time."""
    part = f"('0x' || substr({hex_}, 5 * j + 1, 5))::BIGINT"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({part} >> {s}) & 31)::BIGINT + 1, 1)" for s in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(0, 8), lambda j: {letters}), '')"


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
PLACES = f"docs AS (SELECT doc_id, {WORDS} AS ws FROM documents), ex AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM docs)"

#: SQL has neither the hashes, byte strings, tokenizer and trained models of the other operators, nor is it fit for
#: whole tables there; tests hold those against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH {PLACES}, bench AS (SELECT item_id, {WORDS} AS ws FROM benchmark), b AS (SELECT *, least(10, len(ws)) AS k FROM bench WHERE len(ws) > 0),
        win AS (SELECT DISTINCT item_id, k, array_to_string(ws[i : i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM b)),
        around AS (SELECT doc_id, p, list(w) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM ex),
        part AS (SELECT doc_id, p, k, array_to_string(l[1 : k], ' ') AS s FROM around JOIN (SELECT DISTINCT k FROM win) ON len(l) >= k),
        hits AS (SELECT doc_id, p, k, item_id FROM part JOIN win USING (k, s)),
        covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY 1)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
        FROM docs LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)""",
    "op10_stupid_backoff": f"""
        WITH {PLACES}, g AS (SELECT *, lag(w, 1) OVER o AS v, lag(w, 2) OVER o AS u FROM ex WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
        c1 AS (SELECT w, count(*) AS n1 FROM g GROUP BY 1), c2 AS (SELECT v, w, count(*) AS n2 FROM g WHERE v IS NOT NULL GROUP BY 1, 2), c3 AS (SELECT u, v, w, count(*) AS n3 FROM g WHERE u IS NOT NULL GROUP BY 1, 2, 3),
        j AS (SELECT g.doc_id, g.u, g.v, a.n1, b.n1 AS m1, c2.n2, d.n2 AS m2, c3.n3 FROM g JOIN c1 a ON a.w = g.w LEFT JOIN c1 b ON b.w = g.v LEFT JOIN c2 ON c2.v = g.v AND c2.w = g.w LEFT JOIN c2 d ON d.v = g.u AND d.w = g.v LEFT JOIN c3 ON c3.u = g.u AND c3.v = g.v AND c3.w = g.w),
        s1 AS (SELECT *, ln(n1 / (SELECT count(*) FROM ex)) AS a FROM j), s2 AS (SELECT *, CASE WHEN v IS NULL THEN a WHEN n2 >= 1 THEN ln(n2 / m1) ELSE ln(0.4::DOUBLE) + a END AS b FROM s1),
        s3 AS (SELECT doc_id, CASE WHEN u IS NULL THEN b WHEN n3 >= 1 THEN ln(n3 / m2) ELSE ln(0.4::DOUBLE) + b END AS s FROM s2), t AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM s3 GROUP BY 1)
        SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(s, 0), 4) + 0.0 AS score, round(s / n, 4) + 0.0 AS mean_score FROM docs LEFT JOIN t USING (doc_id)""",
    "op11_spelling": f"""
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
        runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
        coded AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 7),
        hashed AS (SELECT run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM coded, crc),
        w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
        cut AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
        one AS (SELECT DISTINCT a.word AS a, w.word AS b FROM cut a JOIN w ON a.rest = w.word),
        near AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word UNION ALL SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
        best AS (SELECT a AS word, b, w.n AS bn, count(*) OVER (PARTITION BY a) AS n_near FROM near JOIN w ON w.word = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) = 1),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN bn >= 10 * w.n THEN b END AS form, CASE WHEN bn >= 10 * w.n THEN bn END AS form_n FROM w LEFT JOIN best USING (word)),
        chain AS (SELECT word, word AS here, 0 AS d FROM f UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN f ON f.word = c.here WHERE f.form IS NOT NULL)
        SELECT word, n, n_near, form, form_n, (SELECT arg_max(here, d) FROM chain c WHERE c.word = f.word) AS root FROM f""",
    "op12_centroids": f"""
        WITH k AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q, sha256('1:' || vec_id) AS h FROM embeddings WHERE {FITS}),
        c0 AS (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, q FROM k QUALIFY row_number() OVER (ORDER BY h) <= 16), {', '.join(map(_round, range(4)))}
        SELECT vec_id, c AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(o.q, ',')) AS centroid_sha256 FROM a3 JOIN c3 o USING (c)""",
    "op13_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_base32('sha1(html)')} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p""",
}
