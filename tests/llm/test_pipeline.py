import corpus_pipeline
from tests.llm import test_decontam, test_simhash, test_suffix
from tests.llm.helpers import odd_documents
from tests.llm.test_tokens import ids_of
from vexel.llm import common


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    labels = {r.doc_id: r.quality for r in common.table(spark, sf, "labels").collect()}
    given = [docs]
    for _, stage in corpus_pipeline.STAGES:
        given.append(common.stored(stage(spark, given[-1], sf)))
    assert all(g.columns == docs.columns for g in given[:-1])
    whole, good, single, cut, clean, tokens = map(rows_of, given)
    assert set(good) < set(whole) and sum(labels.get(i) == 1 for i in set(whole) - set(good)) <= 0.03 * len(whole)
    assert all(good[i] == whole[i] for i in good)
    groups = test_simhash.brute([(i, r.text) for i, r in good.items()])
    assert set(single) == {d for d, _, c in groups if d == c}
    kept = {d: h for d, _, _, _, h in test_suffix.brute([(i, r.text) for i, r in single.items()])}
    plain = {d for d, _, n, _, _ in test_suffix.brute([(i, r.text) for i, r in single.items()]) if n == 0}
    assert set(cut) == set(single) == set(kept) and all(cut[i] == single[i] for i in plain)
    import hashlib

    assert sum(hashlib.sha256(r.text.encode()).hexdigest() == kept[i] for i, r in cut.items()) >= 0.95 * len(cut)
    bench = [(r.item_id, r.text) for r in common.table(spark, sf, "benchmark").collect()]
    assert set(clean) == {d for d, _, _, _, _, hit in test_decontam.brute([(i, r.text) for i, r in cut.items()], bench) if not hit}
    want = dict(zip(clean, ids_of(r.text for r in clean.values())))
    assert {i: r.ids for i, r in tokens.items()} == want and all(tokens[i].decoded == r.text for i, r in clean.items())
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_empty_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "labels", "benchmark"):
        common.table(spark, sf, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (4, 1), (7, 1), (None, 1), (9, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "fox sleeps well"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = common.table(spark, str(tmp_path), "documents")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        given = common.stored(stage(spark, given, str(tmp_path)))
        assert i == 4 or given.schema.simpleString() == docs.schema.simpleString()
    ids = sorted((r.doc_id is not None, r.doc_id or 0, r.decoded) for r in given.collect())
    # 1 is contaminated; its copies of id 4, the null and the wordless texts are near-duplicates of earlier ones.
    assert [i for _, i, _ in ids] == [0, 2, 6, 7, 8, 9] and ids[0][2] == "a text without an id" and ids[1][2] == ""


def test_only_the_last_result_is_left(spark):
    mark = common.working()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() and common.working() == mark + 1
    common.release(spark, mark)


def test_release_leaves_other_scopes_alone(spark):
    kept = common.stored(spark.range(3))
    mark = common.working()
    with common.scope():
        dropped = common.shared_dir(spark)
        common.stored(spark.range(5), dropped)
        common.release(spark)
        left = common.stored(spark.range(2))
    assert kept.count() == 3 and left.count() == 2 and common.working() == mark + 1
    import os

    assert not os.path.exists(dropped)
    common.release(spark, mark)
