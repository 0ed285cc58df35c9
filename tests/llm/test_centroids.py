import hashlib
import math

import pytest

from vexel.llm import centroids


def brute(rows):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(64 * x) <= 2**27 for x in v):
            kept.append((i, tuple(math.floor(64 * x) for x in v)))
    h = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centres = [q for _, q in sorted(kept, key=lambda r: (r[0] is None, h(r[0]), r[1]))[:16]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda q: min((gap(q, c), i) for i, c in enumerate(centres))
    for _ in range(3):
        own = [assign(q)[1] for _, q in kept]
        sums = {}
        for (_, q), c in zip(kept, own):
            sums.setdefault(c, []).append(q)
        centres = [tuple(sum(x) // len(sums[i]) for x in zip(*sums[i])) if i in sums else c for i, c in enumerate(centres)]
    found = [(i, *assign(q)[::-1]) for i, q in kept]
    total = sum(d for _, _, d in found)
    per = {c: sum(d for _, o, d in found if o == c) for _, c, _ in found}
    return sorted(((i, c, d, per[c], total, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found), key=str)


def given(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert given(centroids.clustered(table)) == brute([(r.vec_id, r.embedding) for r in table.collect()])


def test_odd_rows(spark):
    def v(*head, n=64):
        return ([float(x) for x in head] + [0.25] * n)[:n]

    rows = [(i, v(i / 50, -i / 70, (i * i % 13) / 9)) for i in range(90)]
    rows += [(100 + i, v(0.5, 0.5)) for i in range(60)]  # copies of one vector
    rows += [(7, v(3, 4)), (7, v(4, 3)), (7, v(3, 4)), (None, v(1, 1)), (None, v(2, 2)), (200, None), (201, []), (202, v(1, n=63)), (203, v(1, n=65)), (204, v("nan")), (205, v("inf")), (206, v("-inf"))]
    rows += [(207, [None] + v()[1:]), (208, v(-0.0, 1e-30, -1e-30)), (209, v(3e5, -2e6)), (210, v(1e30)), (211, v(2**21)), (212, v(-(2.0**21)))]
    df = spark.createDataFrame([(i, x, 1, 2, "h") for i, x in rows], "vec_id long, embedding array<double>, cluster int, w long, h string").repartition(5)
    assert given(centroids.clustered(df)) == brute(rows)
    assert centroids.clustered(df.limit(0)).collect() == []
    few = df.where("vec_id in (3, 5)")
    assert given(centroids.clustered(few)) == brute([r for r in rows if r[0] in (3, 5)])


def test_copies_are_one_row(spark):
    df = spark.createDataFrame([(i, [i % 3 / 64.0] * 64) for i in range(30)], "vec_id long, embedding array<float>")
    distinct = centroids.weighted(centroids.quantised(df))
    assert sorted((r.q[0], r.w) for r in distinct.collect()) == [(0, 10), (1, 10), (2, 10)]


def test_ties_go_to_the_smaller_number():
    import numpy as np

    own, d = centroids.nearest(np.array([[0], [1], [5]]), np.array([[2], [0], [0]]))
    assert own.tolist() == [1, 0, 0] and d.tolist() == [0, 1, 9]


@pytest.mark.parametrize("k, rounds", [(1, 1), (5, 8)])
def test_other_parameters(spark, k, rounds):
    df = spark.createDataFrame([(i, [float(i), float(i % 4)]) for i in range(40)], "vec_id long, embedding array<double>")
    found = centroids.clustered(df, k=k, rounds=rounds, dims=2, scale=1).collect()
    assert len(found) == 40 and {r.cluster for r in found} <= set(range(k))
