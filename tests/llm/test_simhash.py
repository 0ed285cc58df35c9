import numpy as np
import xxhash

from tests.llm.helpers import odd_documents
from vexel.llm import simhash


def brute_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws, w = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            ws, w = ws + [w] if w else ws, ""
        else:
            w += c
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in sh], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(sh))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3):
            root[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def given(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert given(simhash.near_duplicates(docs)) == brute(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert given(simhash.near_duplicates(docs)) == brute(rows)
    assert given(simhash.near_duplicates(odd_documents(spark, empty=True))) == []
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {1, None} <= {r.doc_id for r in kept.collect()} and 4 not in {r.doc_id for r in kept.collect()}


def test_long_lists_link_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3)
    prints = sorted({int(b) ^ sum(1 << int(x) for x in set(rng.integers(0, 20, n))) for b in base for n in rng.integers(0, 5, 150)} | {int(x) for x in rng.integers(0, 2**63, 200)})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")

    def groups():
        found = {p: p for p in prints}
        for r in simhash.components(simhash.links(frame)).collect():
            found[r.node] = r.root
        return found

    usual = groups()
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= 3:
                r, s = find(a), find(b)
                root[max(r, s)] = min(r, s)
    want = {p: find(p) for p in prints}
    assert usual == want
    monkeypatch.setattr(simhash, "LONG", 8)
    assert groups() == want


def test_one_of_each_goes_by_rows(spark):
    a, b, c = ("a first text about one thing", "another one that says something else", "the third is unlike both of them")
    docs = spark.createDataFrame([(2, b, 1), (5, a, 2), (5, b, 3), (7, c, 4), (8, a, 5), (None, a, 6)], "doc_id long, text string, sha256 long")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.sha256 for r in kept.collect()) == [1, 2, 4, 6]
