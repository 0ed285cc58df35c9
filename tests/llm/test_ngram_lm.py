import math
from collections import Counter

import numpy as np
import pandas as pd

from tests.llm.helpers import odd_documents
from vexel.llm import common, ngram_lm, queries
from vexel.llm.decontam import words


def brute(rows, order=3, alpha=0.4, cut=1):
    docs = [(d, words((t or "").encode())) for d, t in rows]
    counts = [Counter(tuple(w[i : i + k]) for _, w in docs for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
    total = sum(len(w) for _, w in docs)

    def s(gram):
        c = counts[len(gram) - 1][gram]
        if len(gram) == 1:
            return c / total
        return c / counts[len(gram) - 2][gram[:-1]] if c >= cut else alpha * s(gram[1:])

    out = []
    for d, w in docs:
        score = sum(math.log(s(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))
        out.append((d, len(w), round(score, 6), round(score / len(w), 6) if w else None))
    return sorted(out, key=str)


def given(df):
    return sorted(((r.doc_id, r.n_words, round(r.score, 6), None if r.mean_score is None else round(r.mean_score, 6)) for r in df.collect()), key=str)


def close(a, b):
    assert [x[:2] for x in a] == [x[:2] for x in b]
    for x, y in zip(a, b):
        assert abs(x[2] - y[2]) < 1e-4 * max(1, abs(y[2]))


def test_texts_of_several_slices_and_what_is_left(spark):
    rng = np.random.default_rng(0)
    long = " ".join(f"w{i}" for i in rng.integers(0, 3000, 400_000))
    rows = [(1, long), (2, long[1_000_000:]), (3, "w1 w2 w3"), (4, None)]
    mark = common.working()
    close(given(ngram_lm.scores(spark.createDataFrame(rows, "doc_id long, text string"))), brute(rows))
    held = [t.name for t in spark.catalog.listTables() if t.name.startswith("vexel_lm_")]
    common.release(spark, mark)
    assert held and not [t.name for t in spark.catalog.listTables() if t.name in held]


def test_whole_table(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    close(given(ngram_lm.scores(docs)), brute(rows))
    close(given(ngram_lm.scores(docs, cut=2)), brute(rows, cut=2))
    monkeypatch.setattr(ngram_lm, "BLOCK", 100_000)
    close(given(ngram_lm.scores(docs)), brute(rows))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    close(given(ngram_lm.scores(docs)), brute(rows))
    assert ngram_lm.scores(odd_documents(spark, empty=True)).collect() == []


def test_the_query_counts_every_ngram(spark, tmp_path):
    rows = [(1, "one word pair that stands once"), (2, "one word pair more"), (3, "unlike all others"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = given(queries.op10_stupid_backoff(spark, str(tmp_path)))
    close(got, brute(rows))
    assert abs(got[2][2] - math.log(1 / 13)) < 1e-3  # each word after the first is certain


def test_counts_beyond_32_bits():
    keys, n = np.array([5, 9], np.uint64).tobytes(), np.array([4_000_000_000, 3], "<u4").tobytes()
    out = ngram_lm._count(pd.DataFrame({"part": [0, 0], "block": ["a", "b"], "keys": [keys, keys], "n": [n, n]}))
    assert [ngram_lm._wide(x).tolist() for x in out["counts"]] == [[8_000_000_000, 6]] * 2
