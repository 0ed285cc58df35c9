import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import odd_documents
from vexel.llm import spelling


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
                run = ""
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(counts):
    by_rest = {}
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_rest.setdefault(key, set()).add(w)
    out = {}
    for w, n in counts.items():
        others = {x for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in by_rest[key] if near(w, x)}
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= 10 * n else None
        out[w] = [n, len(others), form, counts[form] if form else None]
    rows = []
    for w, (n, k, form, form_n) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.append((w, n, k, form, form_n, root))
    return sorted(rows)


def given(df):
    return sorted(map(tuple, df.select("word", "n", "n_near", "form", "form_n", "root").collect()))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute(brute_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert sum(r[3] is not None for r in want) > 100
    assert given(spelling.spelling_groups(docs)) == want


@pytest.mark.parametrize("large, small, chunk", [(1 << 22, 24, 1 << 22), (200, 2, 64), (30, 1, 1)])
def test_dense_words(spark, monkeypatch, large, small, chunk):
    """Few letters: every block is crowded, words have many near ones, and some differ in either half."""
    monkeypatch.setattr(spelling, "SMALL", small)
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abÿ"), rng.integers(1, 9))): int(rng.choice([1, 3, 40, 500])) for _ in range(700)}
    words |= {"x" * 300: 5, "x" * 299: 70, "x" * 150 + "y" + "x" * 149: 900, "x" * 301: 50, "a": 3, "b": 3, "": 0} | {f"long{c}word{d}": 2 for c in "abcdefg" for d in "hijklmn"}
    words.pop("")
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    found = sorted(map(tuple, spelling.near_words(df, large).select("word", "n_near", "best_n", "best").collect()))
    want = []
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            want.append((w, len(others), words[best], best))
    assert found == sorted(want)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(20, "Abcdefgh abcdefgh ABCDEFGH×× abcdefg " * 9), (21, "abcdefxh abcdefxh naïvement naïvement naivement"), (22, "z" * 40_000 + " " + "z" * 40_000)]
    docs = spark.createDataFrame([(i, t, 1, "m") for i, t in rows], "doc_id long, text string, n long, shared string")
    assert given(spelling.spelling_groups(docs)) == brute(brute_words(rows))
    assert given(spelling.spelling_groups(odd_documents(spark, empty=True))) == []


def test_a_chain_of_forms(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb", "abbbbbb"]
    df = spark.createDataFrame([(w, 2 * 10**i) for i, w in enumerate(chain)], "word string, n long")
    assert {r.root for r in spelling.variants(df).collect()} == {"abbbbbb"}
