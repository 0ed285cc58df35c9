import hashlib
import re

from tests.llm.helpers import odd_documents
from vexel.llm import decontam


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, n=10):
    wins = {}
    for i, t in bench:
        ws = brute_words(t)
        for j in range(max(1, len(ws) - n + 1)) if ws else ():
            wins.setdefault(tuple(ws[j : j + n]), set()).add(i)
    lens = {len(w) for w in wins}
    out = []
    for d, t in docs:
        ws = brute_words(t)
        hit, items = set(), set()
        for k in lens:
            for j in range(len(ws) - k + 1):
                if (own := wins.get(tuple(ws[j : j + k]))) is not None:
                    hit |= set(range(j, j + k))
                    items |= own
        names = sorted(str(i) for i in items if i is not None)
        out.append((d, len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows_of(df, a, b):
    return [(r[a], r[b]) for r in df.select(a, b).collect()]


def test_whole_tables(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute(rows_of(docs, "doc_id", "text"), rows_of(bench, "item_id", "text"))
    got = sorted(map(tuple, decontam.contamination(docs, bench).collect()), key=str)
    assert got == want and any(w[5] for w in want)


def test_odd_rows_and_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(10, "The lazy DOG!"), (9, "lazy dog and then"), (10, "the lazy dog"), (None, "quick brown"), (3, None), (4, ""), (5, "word " * 12), (6, "zebra none")], "item_id long, text string")
    docs = odd_documents(spark)
    want = brute(rows_of(docs, "doc_id", "text"), rows_of(bench, "item_id", "text"))
    assert sorted(map(tuple, decontam.contamination(docs, bench).collect()), key=str) == want
    monkeypatch.setattr(decontam, "QUERY_BYTES", 150)
    assert sorted(map(tuple, decontam.contamination(docs, bench).collect()), key=str) == want
    assert decontam.contamination(odd_documents(spark, empty=True), bench).count() == 0
    none = decontam.contamination(docs, bench.limit(0)).collect()
    assert len(none) == docs.count() and not any(r.contaminated for r in none)
    assert 1 not in {r.doc_id for r in decontam.clean(docs, bench).collect()}


def test_equal_shards_and_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"the passage number{i} of the benchmark") for i in range(8)], "item_id long, text string")
    rows = [(None, "here is the passage number3 of the benchmark again")] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(decontam, "SHARD", 1)  # a shard for each Arrow batch
    monkeypatch.setattr(decontam.common, "ARROW_BYTES", 1)
    monkeypatch.setattr(decontam, "QUERY_BYTES", 150)
    assert sorted(map(tuple, decontam.contamination(docs, bench).collect()), key=str) == brute(rows, rows_of(bench, "item_id", "text"))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "f e x x x a"), (3, "a")], "doc_id long, text string")
    index = decontam.build_index(docs)
    assert sorted(map(tuple, decontam.proximity_matches(index, ["a", "e"], 4).collect())) == [(1, 0), (2, 5)]
    assert sorted(map(tuple, decontam.proximity_matches(index, ["a", "e"], 3).collect())) == []


def test_texts_of_several_slices(spark):
    """Windows within a slice, over the end of one, and words that are cut by none."""
    text = "lorem ipsum " * 87_381
    text = text[: (1 << 20) - 9] + "the secret passage of the benchmark " + "dolor " * 300_000 + "w" * 1_500_000 + " the secret passage of the benchmark"
    assert decontam.words(text.encode()) == [w.encode() for w in brute_words(text)]
    docs = [(1, text), (2, "dolor " * 400_000), (3, "passage of the")]
    bench = spark.createDataFrame([(1, "The secret passage, of the BENCHMARK"), (2, "dolor lorem")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, decontam.contamination(df, bench).collect()), key=str) == brute(docs, rows_of(bench, "item_id", "text"))


def test_clean_goes_by_rows(spark):
    bench = spark.createDataFrame([(1, "the secret passage")], "item_id long, text string")
    rows = [(1, "here is the secret passage", "a"), (1, "nothing here", "b"), (None, "the secret passage", "c"), (None, None, "d"), (2, "nothing here", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == ["b", "d", "e"]
