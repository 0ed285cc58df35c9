import zlib
from pathlib import Path

import numpy as np
import pytest

from tests.llm.helpers import odd_documents
from vexel.llm import quality, toxicity


@pytest.mark.parametrize(("sf", "least"), [("/root/testdata/sf0.01", 0.8), ("/root/testdata/sf0.1", 0.95)])
def test_toxicity_on_held_out_rows(spark, sf, least):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    right = sum(g.predicted == t for g, t in held) / len(held)
    pairs = [(a.score, b.score) for a, t in held for b, u in held if t > u]
    auc = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    assert right >= 0.9 and auc >= least, (right, auc)


def test_toxicity_keeps_rare_expressions(spark):
    rows = [(i, f"some plain words{i % 7} and {'zorg blick fump' if i % 2 else 'other'} words{i % 5} here", i % 2) for i in range(80)]
    rows += [(100 + i, f"onceword{i} seen{i} here", i % 2) for i in range(40)]
    model, _ = toxicity.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int"))
    ratio = lambda text: model.value.evidence(text)[0]
    unknown = ratio(b"never met")
    assert ratio(b"blick") > unknown + 0.4 and ratio(b"fump") > unknown + 0.4 and ratio(b"blick fump") > unknown + 0.2
    once = [(ratio(f"onceword{i} seen{i}".encode()) - unknown) * (1 if i % 2 else -1) for i in range(40)]
    assert sum(x > 1e-3 for x in once) >= 15 and min(once) > -1e-3  # those of the rows that are learnt from


def test_toxicity_learns_from_every_labelled_row(spark):
    """Each row has a word of its own, which only a count of that row can know."""
    n = 12_000
    docs = spark.createDataFrame([(i, f"{('good', 'bad')[i % 2]} own{i}") for i in range(n)] + [(n, "good unknown"), (n + 1, "bad unknown")], "doc_id long, text string")
    got = [r.score for r in toxicity.scores(docs, spark.range(n).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")).orderBy("doc_id").collect()]
    learnt = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5]
    assert len(learnt) > 9000 and got[n] < 0.5 < got[n + 1]
    assert all(got[i] > got[n + 1] if i % 2 else got[i] < got[n] for i in learnt)
    assert {got[i] for i in range(n) if i not in set(learnt)} == {got[n], got[n + 1]}


def test_toxicity_of_blocks_by_the_whole_model(spark):
    """Scores from blocks and parts are those of one model with all counts in one place, curve included."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model, (weights, bias) = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.scores(docs.repartition(7), labels).collect()}
    for r in docs.collect():
        z = float(np.dot(model.value.evidence((r.text or "").encode()), weights) + bias)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-4


def test_toxicity_answers_are_smaller_than_the_blocks(spark, sf, monkeypatch):
    """A block knows what it counts itself, so answers to it hold little; the disk of large inputs goes by them."""
    held = {}

    def put(df, name, *rest):
        keep(df, name, *rest)
        held[name.split("_", 3)[3] if name.count("_") > 2 else "blocks"] = sum(p.stat().st_size for f in spark.table(name).inputFiles() for p in [Path(f.removeprefix("file:"))])

    keep = toxicity.common.put_table
    monkeypatch.setattr(toxicity.common, "put_table", put)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert toxicity.scores(docs.where("doc_id % 2 = 0").coalesce(1).unionByName(docs.where("doc_id % 2 = 1").coalesce(1)), labels).count() == docs.count()
    assert sum(n for name, n in held.items() if name.startswith("pairs")) < 0.12 * held["blocks"], held


def test_quality_on_rows_not_learnt(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learnt = labels.where("doc_id % 3 <> 0")
    got = {r.doc_id: r for r in quality.scores(docs, learnt).collect()}
    rest = [(int(got[r.doc_id].keep), r.quality) for r in labels.where("doc_id % 3 = 0").collect()]
    assert sum(p == t for p, t in rest) / len(rest) >= 0.9


def test_quality_rounds_by_brute_force(spark):
    """Co-training with all rows in memory: the surest guesses over all unlabelled documents, round by round."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    rows = sorted(docs.select("doc_id", "text", "lang", "source").collect())
    known = {r.doc_id: r for r in labels.selectExpr("doc_id", "quality", "pmod(xxhash64(doc_id, 5), 4) = 0 AS held").collect()}
    xs = [np.array([quality.content(r.text.encode()) for r in rows], np.float32), np.array([quality.metadata(r.text.encode(), r.lang, r.source) for r in rows], np.float32)]
    whole = [x.astype(float) for x in xs]
    y = np.array([known[r.doc_id].quality if r.doc_id in known else -1 for r in rows])
    held = np.array([r.doc_id in known and known[r.doc_id].held for r in rows])
    taken = [np.where((y >= 0) & ~held, y, -1) for _ in xs]
    views = [quality.View(), quality.View()]
    for turn in range(quality.ROUNDS + 1):
        for v, view in enumerate(views):
            view.fit(xs[v][taken[v] >= 0], taken[v][taken[v] >= 0])
        if turn < quality.ROUNDS:
            z = [view.margin(x) for view, x in zip(views, whole)]
            for v in (0, 1):
                order = [i for i in np.argsort(z[1 - v], kind="stable") if y[i] < 0 and taken[v][i] < 0]
                low, high = order[: quality.GIVEN // 2], order[::-1][: quality.GIVEN // 2]
                taken[v][[i for i in low if z[1 - v][i] < 0]] = 0
                taken[v][[i for i in high if z[1 - v][i] > 0]] = 1
    own, share = y[held], y[y >= 0].mean()
    weight = np.where(own == 1, share / own.sum(), (1 - share) / (len(own) - own.sum()))
    for view, x in zip(views, xs):
        view.calibrate(x[held], own, weight)
    margins = np.array([view.margin(x[held]) for view, x in zip(views, xs)])
    model = quality.Classifier(views, *quality.linear.logistic(margins.T, own, weight, l2=1e-4))
    want = model.scores(whole)
    assert max(abs(got[r.doc_id].score - want[2][i]) for i, r in enumerate(rows)) < 0.02
    assert sum((got[r.doc_id].score >= 0.5) != (want[2][i] >= 0.5) for i, r in enumerate(rows)) <= 1


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 0, 1), (7, 0, 0), (None, 1, 1), (9, None, None), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (toxicity.scores, quality.scores):
        assert f(docs, labels).count() == docs.count()
        assert f(odd_documents(spark, empty=True), labels).count() == 0
        scores = [r.score for r in f(docs, labels.limit(0)).collect()]
        assert len(set(scores)) == 1 and 0 <= scores[0] <= 1
    assert quality.good(docs, labels).columns == docs.columns


def brute_model(texts, labels):
    """Probabilities of words and pairs by the formulas, from dictionaries."""
    from collections import Counter

    pairs, before, after = [Counter(), Counter()], [{}, {}], [Counter(), Counter()]
    for text, c in zip(texts, labels):
        ws = text.lower().split()
        for v, w in zip([None, *ws], ws):
            before[c].setdefault(w, set()).add(v)
            if v is not None:
                pairs[c][v, w] += 1
                after[c][v] += 1
    words = set(before[0]) | set(before[1])
    # Words before a word in either class, a text's start aside.
    shared = {w: len((before[0].get(w, set()) | before[1].get(w, set())) - {None}) + 0.5 for w in words}
    whole = sum(shared.values()) + 0.5

    def single(c, w):
        n = {x: len(s) for x, s in before[c].items()}
        total = sum(n.values())
        kept = sum(x - 0.75 for x in n.values())
        return max(n.get(w, 0) - 0.75, 0) / total + (1 - kept / total) * shared.get(w, 0.5) / whole

    def pair(c, v, w):
        kinds = sum(x == v for x, _ in pairs[c])
        both = pairs[0][v, w] + pairs[1][v, w]
        all_after, all_kinds = after[0][v] + after[1][v], len({x for k in pairs for x in k if x[0] == v})
        low = (both - 0.5 + 0.5 * all_kinds * single(c, w)) / all_after if both else single(c, w)
        back = 0.75 * kinds / after[c][v] if after[c][v] else 1
        return max(pairs[c][v, w] - 0.75, 0) / max(after[c][v], 1) + back * low

    return single, pair


def test_toxicity_by_the_formulas(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abcdefghij"), 12, p=np.array([9, 8, 7, 6, 5, 4, 3, 2, 1, 1]) / 46)) for _ in range(40)]
    labels = [i % 2 for i in range(40)]
    rows = spark.createDataFrame(list(zip([t.encode() for t in texts], labels)), "text binary, label int")
    model = toxicity._model(toxicity._learn(rows))
    single, pair = brute_model(texts, labels)
    for text in ["a", "b zz a", "a b c d e f g h i j", "zz", "j j j i h"]:
        ws = text.split()
        want = [np.log(single(1, w) / single(0, w)) for w in ws]
        whole = want[:1] + [np.log(pair(1, v, w) / pair(0, v, w)) for v, w in zip(ws, ws[1:])]
        got = model.evidence(text.encode())
        assert abs(got[0] - np.mean(whole)) < 1e-5 and abs(got[1] - np.mean(sorted(want)[-2:])) < 1e-9
