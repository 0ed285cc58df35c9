import hashlib
from functools import lru_cache

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import odd_documents
from vexel.llm import winnow


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def spark_hash(*values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.encode(), seed)
    return signed(seed)


@lru_cache(maxsize=None)
def brute_kept(text, k=16, w=16):
    t = text.encode()
    if not t:
        return []
    grams = [spark_hash(t[i : i + k]) & 0xFFFFFFFF for i in range(max(1, len(t) - k + 1))]
    kept = []
    for i in range(max(1, len(grams) - w + 1)):
        own = grams[i : i + w]
        at = i + max(j for j, g in enumerate(own) if g == min(own))
        if at not in kept[-1:]:
            kept.append(at)
    return [(grams[p], p) for p in kept]


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def spark_rows(spark, texts):
    """The fingerprints that texts have as documents of their own."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.fingerprint for r in winnow.edited_fingerprints(docs).collect()]


def check(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1]), r[1]))
    want, texts = [], []
    for (d, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        texts.append((d, edited))
        a, b, c = brute_kept(t), brute_kept(edited), brute_kept(nxt)
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(a, b), likeness(a, c)))
    got = winnow.edited_fingerprints(docs).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=key) == sorted(want, key=key)
    entries = {(r.doc_id, tuple((e.hash, e.position) for e in r.entries)) for r in winnow.fingerprints(docs).collect()}
    assert entries == {(d, tuple(brute_kept(t))) for d, t in rows}
    digests = {(r.doc_id, r.edited_sha256, r.edited_fingerprint) for r in got}
    edited = spark_rows(docs.sparkSession, [t for *_, t in texts])
    assert {e for *_, e in digests} == set(edited)
    by_text = {}
    for (d, t), r in zip(rows, sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0))):
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint or d is None


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_rows(spark):
    check(odd_documents(spark))
    check(odd_documents(spark).limit(1))
    assert winnow.edited_fingerprints(odd_documents(spark, empty=True)).collect() == []


@pytest.mark.parametrize("rows", [1, 50])
def test_many_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(winnow, "BLOCK_ROWS", rows)
    monkeypatch.setattr(winnow, "CHUNK", 40)
    monkeypatch.setattr(winnow, "STEP", 3)
    texts = [(i % 37 if i % 5 else None, "text %d " % (i % 11) * (i % 23)) for i in range(150)]
    check(spark.createDataFrame(texts, "doc_id long, text string"))


def test_shared_runs_share_a_hash_at_their_place(spark):
    rng = np.random.default_rng(1)
    rows, runs = [], []
    for i in range(60):
        letters = list("日本語文字列检索") if i % 2 else list("abcdefg")
        word = lambda n, letters=letters: "".join(rng.choice(letters, n))
        run = word(31)
        before = [word(int(rng.integers(0, 60))) for _ in range(2)]
        rows += [(2 * i, before[0] + run + word(40)), (2 * i + 1, before[1] + run + word(7))]
        runs.append([len(b.encode()) for b in before] + [len(run.encode())])
    got = {r.doc_id: {(e.position, e.hash) for e in r.entries} for r in winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (a, b, n) in enumerate(runs):
        shared = {(p - a, h) for p, h in got[2 * i] if a <= p <= a + n - 16} & {(p - b, h) for p, h in got[2 * i + 1]}
        assert shared
