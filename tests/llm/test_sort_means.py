import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrica.llm import sort_means as S


def brute(vectors, k, rounds, dims, scale=64):
    """Plain k-means in Python integers; vectors: (id, list or None)."""
    import math

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in seeds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(assign(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(centroids)]
    return [(i, *assign(v)[::-1]) for i, v in kept], centroids


def table(spark, rows, dims_type="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {dims_type}, label int, cluster string")


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize(("k", "rounds", "seed"), [(16, 3, 1), (5, 6, 2), (40, 2, 3)])
def test_equal_to_plain_k_means(spark, k, rounds, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=4).round(1) * 0.2).tolist(), 0, "x") for i in range(120)]
    rows += [(500 + i, rows[7][1], 0, "x") for i in range(150)] + [(7, rows[7][1], 0, "x"), (None, rows[3][1], 0, "x")]  # a hot vector, a repeated id, none
    told, centroids = S.sort_means(table(spark, rows), k, rounds, 4)
    want, ends = brute([(r[0], r[1]) for r in rows], k, rounds, 4)
    assert key([tuple(r) for r in told.collect()]) == key(want) and centroids.tolist() == ends
    full = S.with_inertia(told, centroids).collect()
    assert {r.inertia for r in full} == {sum(d for *_, d in want)} and len(full) == len(rows)
    for r in full[:20]:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, ends[r.cluster])).encode()).hexdigest()
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)


def test_only_whole_finite_vectors_are_kept(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.01]), (2, None), (3, [0.5]), (4, [0.5, None]), (5, [nan, 0.0]), (6, [0.0, -inf]), (7, []), (8, [0.0, 1.0, 2.0]), (9, [-1.0, 0.25])]
    told, centroids = S.sort_means(table(spark, [(i, v, 0, "x") for i, v in rows], "array<float>"), 16, 3, 2)
    assert key([tuple(r) for r in told.collect()]) == key(brute(rows, 16, 3, 2)[0]) and len(centroids) == 2
    assert sorted(map(tuple, centroids.tolist())) == [(-64, 16), (32, -1)]


def test_empty_and_out_of_range(spark):
    for rows in ([], [(1, None, 0, "x")], [(None, [0.0, 0.0], 0, "x")]):
        assert S.with_inertia(*S.sort_means(table(spark, rows), 16, 3, 2)).collect() == []
    with pytest.raises(Exception, match="beyond"):
        S.sort_means(table(spark, [(1, [1e300, 0.0], 0, "x")]), 16, 3, 2)


def test_ties_and_the_scan_ends_early():
    rng = np.random.default_rng(5)
    centers = rng.integers(-500, 500, (24, 8))
    x = centers[rng.integers(0, 24, 3000)] + rng.integers(-20, 21, (3000, 8))
    before = rng.integers(0, 24, 3000)
    all_d = ((x[:, None, :] - centers[None]) ** 2).sum(2)
    once, d, first = S.nearest(x, before, centers)
    again, d2, second = S.nearest(x, once, centers)
    assert (once == all_d.argmin(1)).all() and (d == all_d.min(1)).all() and (again == once).all() and (d2 == d).all()
    assert second < first <= x.shape[0] * 24 and second < 2 * len(x)
    # Halfway between two, at exactly twice the distance: the smaller number, from wherever the scan starts
    pair = np.asarray([[0], [10], [0]])
    for p in range(3):
        cluster, dist, _ = S.nearest(np.asarray([[5], [0], [10]]), np.full(3, p), pair)
        assert cluster.tolist() == [0, 0, 1] and dist.tolist() == [25, 0, 0]


def test_other_columns_are_free(spark):
    rows = [(i, [float(i), 0.0], 0, "x") for i in range(6)]
    df = table(spark, rows).withColumns({"v": F.lit("clash"), "distance": F.lit(1), "k": F.lit(2)})
    told, _ = S.sort_means(df, 2, 1, 2)
    assert told.count() == 6
