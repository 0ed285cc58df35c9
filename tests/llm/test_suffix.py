import hashlib

import numpy as np
import pytest

from tests.llm.helpers import odd_documents
from vexel.llm import common, suffix


def brute(rows, length=50):
    first = {}
    for d, t in rows:
        t = (t or "").encode()
        if d is not None:
            for i in range(len(t) - length + 1):
                s = t[i : i + length]
                first[s] = min(d, first.get(s, d))
    out = []
    for d, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        if d is not None:
            for i in range(len(t) - length + 1):
                if first[t[i : i + length]] < d:
                    gone[i : i + length] = True
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n in [*range(1, 60), 200, 1000]:
        for top in (2, 3, 300):
            s = rng.integers(1, top, n)
            want = sorted(range(n), key=lambda i: s[i:].tolist())
            assert suffix.suffix_array(s).tolist() == want
            got = [s[i : i + 12].tolist() for i in suffix.suffix_array(s, 12)]
            assert got == sorted(got)


@pytest.mark.parametrize("hot", [4096, 1])
def test_whole_table(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "BLOCK", 300_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, suffix.removals(docs).collect()), key=str)
    assert got == brute(rows) and sum(g[2] for g in got)


def test_hard_texts(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abñ"), n))
    base = word(400)
    texts = [base, base, "x" + base[:49], base[100:151] + word(30) + base[100:149], "a" * 500, "b" + "a" * 60, base[::-1], (base[:70] + "ab") * 9, base[10:60] + base[200:260], "ab" * 200, "ba" * 100, base[:50]]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix.removals(docs).collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, suffix.removals(docs).collect()), key=str) == brute(rows)
    assert suffix.removals(odd_documents(spark, empty=True)).collect() == []
    cut = suffix.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert {r.text for r in cut.where("doc_id = 4").collect()} == {""}
    assert [r.text for r in cut.where("doc_id = 2 or doc_id is null").orderBy("doc_id").collect()] == ["a text without an id", None]


def test_rows_of_one_id_keep_their_own_texts(spark):
    base = "some passage that stands in the first document and in both of the others " * 2
    rows = [(1, base, None, 1), (2, base + " AAAA first", [1, 2], 2), (2, base + " BBBB second", None, 3), (2, base + " BBBB second", None, 4), (None, base, [], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `odd name.x` array<int>, rest int")
    got = sorted(suffix.without_repeats(docs).collect(), key=lambda r: r.rest)
    assert [r.text for r in got] == [base, " AAAA first", " BBBB second", " BBBB second", base]
    assert [tuple(r)[2:] for r in got] == [r[2:] for r in rows] and suffix.without_repeats(docs).schema == docs.schema


def test_working_tables_can_be_dropped(spark):
    mark, before = common.working(), spark.catalog.listTables()
    assert suffix.removals(odd_documents(spark)).count() == 11 and len(spark.catalog.listTables()) > len(before)
    common.release(spark, mark)
    assert spark.catalog.listTables() == before and common.working() == mark


def test_copies_are_not_followed(spark, monkeypatch):
    """Whole copies share no anchors with what is followed, and what a part of them shares with others still counts."""
    rng = np.random.default_rng(8)
    base = ["".join(rng.choice(list("abcdefgh "), 400)) for _ in range(30)]
    texts = base * 4 + [base[0][100:200] + base[1][50:120], base[2][:49], base[2][:49], base[2][:50], base[2][:50]]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)) // 2 * 2, texts)]  # some ids twice
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, suffix.removals(docs).collect()), key=str) == brute(rows)
    known, _ = suffix._marked(spark.createDataFrame(list(enumerate(base * 4)), "doc_id long, text string"), "doc_id", "text")
    assert sum(len(r.at) for r in known.select("at").collect()) == 0
