"""Operators against plain recomputation: quantiles, distances, samples, splines, repair, media status."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.operators import evaluate as E
from stridelake.operators import quality as Q
from stridelake.operators import sampling as O
from stridelake.operators import series as S
from stridelake.operators import vectors as V
from stridelake.operators.quantiles import group_quantiles


@pytest.mark.parametrize("hot_rows", [0, 300, 10**9])
def test_quantiles(spark, hot_rows):
    rng = random.Random(1)
    groups = {"a": [rng.gauss(0, 1) for _ in range(2000)], "b": [float(rng.randrange(4)) for _ in range(999)], "c": [5.0], "d": [1.0, 2.0], "e": [math.exp(rng.gauss(0, 9)) for _ in range(500)], None: [1.0, 3.0, 9.0]}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v] + [("a", None)], "k string, x double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r["q"] for r in group_quantiles(df, ["k"], "x", qs, hot_rows=hot_rows, cuts=16).collect()}
    for k, v in groups.items():
        if k is not None or hot_rows > 3:
            assert np.allclose(got[k], np.quantile(v, qs), rtol=1e-12)
    one = group_quantiles(df, [], "x", [0.5], hot_rows=hot_rows).first()["q"][0]
    assert math.isclose(one, np.quantile([x for v in groups.values() for x in v], 0.5), rel_tol=1e-12)


def test_spline_reproduces_cubics():
    y = np.array([x**3 - 2 * x for x in range(9)], float)
    x = np.linspace(0, 8, 23)
    assert np.allclose(S._not_a_knot(y, x), x**3 - 2 * x)
    assert np.allclose(S._not_a_knot(np.array([1.0, 3.0]), np.array([0.5])), [2.0])


def test_spline_of_a_long_series(spark):
    """More than 100,000 points, in blocks, as if solved at once."""
    n, x = 120_001, np.linspace(0, 120_000, 16)
    df = spark.range(n).selectExpr("'a' as path", "3 * id as win", "double(xxhash64(id) % 1000) + if(id % 977 = 0, 9e12, 0) as energy")
    y = np.array([r["energy"] for r in df.orderBy("win").collect()])
    got = {r["j"]: r["value"] for r in S.spline(df, 16).collect()}
    assert sorted(got) == list(range(16)) and np.allclose([got[j] for j in range(16)], S._not_a_knot(y, x), rtol=1e-12, atol=0)


def test_spline_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(4)
    ys = {str(n): np.exp(5 * rng.standard_normal(n)) for n in (1, 2, 3, 4, 5, 1500, 1501, 1502, 2701, 7000)}
    df = spark.createDataFrame([(k, 2 * i, float(v)) for k, y in ys.items() for i, v in enumerate(y)], "path string, win long, energy double")
    for m in (1, 2, 16, 5000):
        got = {(r["path"], r["j"]): r["value"] for r in S.spline(df, m, block=1500).collect()}
        assert len(got) == len(ys) * m
        for k, y in ys.items():
            assert np.allclose([got[k, j] for j in range(m)], S._not_a_knot(y, np.linspace(0, len(y) - 1, m)), rtol=1e-12, atol=1e-9)


def test_curvature_of_a_spline_solves_all_equations_at_once():
    """Against a dense solution, in the middle of a series that goes on at both sides."""
    y = np.random.default_rng(5).standard_normal(2 * S.HALO + 300)
    n = len(y)
    a = np.zeros((n, n))
    a[0, :3] = a[-1, -3:] = 1, -2, 1
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = 1, 4, 1
    m = np.linalg.solve(a, [0, *(6 * (y[:-2] - 2 * y[1:-1] + y[2:])), 0])
    x = np.linspace(S.HALO, n - S.HALO, 77)
    k = x.astype(int)
    t = x - k
    want = (1 - t) * y[k] + t * y[k + 1] + ((1 - t) ** 3 - (1 - t)) * m[k] / 6 + (t**3 - t) * m[k + 1] / 6
    for cut in ((False, False), (True, False), (False, True), (True, True)):
        assert np.allclose(S._not_a_knot(y, x, cut), want, rtol=1e-12, atol=1e-12)


def test_dtw():
    def plain(a, b):
        d = np.full((len(a) + 1, len(b) + 1), np.inf)
        d[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j + 1], d[i + 1, j], d[i, j])
        return d[-1, -1]

    rng = random.Random(2)
    for _ in range(20):
        a, b = ([rng.random() for _ in range(rng.randrange(1, 12))] for _ in "ab")
        assert math.isclose(V.dtw(a, b), plain(a, b))


def vectors(spark, n=60, k=3):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, i % k, rng.standard_normal(5).tolist()) for i in range(n)], "id long, label long, x array<double>")


def test_blocks_do_not_change_distances(spark):
    v = vectors(spark)
    x = np.array([r["x"] for r in v.orderBy("id").collect()])
    want = {(i, j): np.linalg.norm(x[i] - x[j]) for i in range(60) for j in range(i + 1, 60)}
    orig = V.block_pairs
    try:
        V.block_pairs = lambda a, f, s, **k: orig(a, f, s, **{**k, "block_rows": 17})
        got = {(r["i"], r["j"]): r["dist"] for r in V.pair_distances(v).collect()}
        sil = {r["id"]: r["s"] for r in V.silhouette(v).collect()}
    finally:
        V.block_pairs = orig
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)
    for i in range(60):
        d = {u: np.mean([np.linalg.norm(x[i] - x[j]) for j in range(60) if j != i and j % 3 == u]) for u in range(3)}
        a, b = d[i % 3], min(d[u] for u in d if u != i % 3)
        assert math.isclose(sil[i], (b - a) / max(a, b), abs_tol=1e-6)


def test_average_precision_is_one_when_all_is_right(spark):
    d = spark.createDataFrame([("u", 0.5, i, 1.0 / (i + 1), 1) for i in range(9)] + [("w", 0.75, 0, 0.3, 0)], "unit string, iou double, seg_no long, conf double, tp long")
    n = spark.createDataFrame([(9,)], "npos long")
    got = {r["iou"]: r["ap"] for r in E.average_precision(d, n, ranges=4).collect()}
    assert math.isclose(got[0.5], 1.0) and got[0.75] == 0.0


def test_matching_takes_the_nearest_unused():
    assert E.match_boundaries([1.0, 2.0], [1.9, 2.2], 1.0) == 2
    assert E.match_boundaries([1.0], [1.6, 0.4], 0.5) == 0
    assert E.match_boundaries([], [1.0], 2.0) == 0


def test_samples(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("w", F.when(F.col("id") < 10, 1e6).otherwise(1.0))
    assert {r["n"] for r in O.per_group(df, "g", "id", 7).groupBy("g").agg(F.count("*").alias("n")).collect()} == {7}
    assert O.subset(df, "id", 20).distinct().count() == 20
    assert O.weighted(df, "id", "w", 10).where("id < 10").count() == 10
    assert sum(O.shard(df, 4, i, "id").count() for i in range(4)) == 1000
    p = O.random_pairs(df, "g", "id", 50)
    assert p.count() == 150 and p.where("a = b").count() == 0
    b = O.bootstrap_mean(df.withColumn("v", F.col("id").cast("double")), "g", "v", "id", repeats=60).collect()
    assert all(r["lo"] < r["mean"] < r["hi"] for r in b)


def test_media_status(spark):
    cols = "path string, size long, exit_code int, message string, timed_out boolean, diff_ratio double, diff_mean double, diff_max double, early_exit boolean"
    rows = [("a", 0, 0, "", False, 1.0, 1.0, 1.0, False), ("b", 9, 0, "Moov Atom not found", False, 1.0, 1.0, 1.0, False), ("c", 9, 0, None, True, 1.0, 1.0, 1.0, False), ("d", 9, 0, "", False, 0.0, 0.0, 0.0, False), ("e", 9, 0, "", False, 0.0, 0.0, 0.0, True), ("f", 9, None, None, None, None, None, None, None)]
    got = {r["path"]: r["status"] for r in Q.media_status(spark.createDataFrame(rows, cols), ["moov atom"], 0.1, 0.1, 0.1).collect()}
    assert got == {"a": "empty", "b": "corrupt", "c": "corrupt", "d": "static", "e": "ok", "f": "ok"}


def test_split_is_disjoint(spark):
    f = spark.createDataFrame([(f"f{i:03}",) for i in range(40)], "file string")
    a, b = Q.split_share(f, 0.75), Q.split_share(f, -0.25)
    assert a.count() == 30 and b.count() == 10 and a.intersect(b).count() == 0


def test_plans_push_filters_and_columns(spark, data):
    from stridelake.plans.common import series

    plan = series(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(energy,0.0)" in plan and "HashAggregate(keys=[path" in plan and "SortAggregate" not in plan
    assert "ReadSchema: struct<line_id:bigint,path:string,win_idx:bigint,energy:double>" in plan


def test_nearest_pairs_of_blocks_lose_nothing(spark):
    """Keeping the nearest of each two blocks, over many blocks and with copies, gives what all pairs give."""
    from stridelake.operators import vectors as V

    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 4))
    x[50:] = x[:10]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, x array<double>, label long")
    blocks = V.block_pairs

    def small(a, f, schema, **kw):
        return blocks(a, f, schema, block_rows=13, **kw)

    V.block_pairs = small
    try:
        every = V.pair_distances(df).withColumn("dist", F.round("dist", 9))
        some = V.pair_distances(df, each=3).withColumn("dist", F.round("dist", 9))
        assert some.count() < every.count() == 60 * 59 // 2
        rows = lambda p: {(r["i"], r["j"]) for r in V.knn_of(p, 3).collect()}
        assert rows(some) == rows(every)
        sim = lambda p: [(r["i"], r["j"]) for r in V.top_pairs(p.select("i", "j", F.round(1 - F.col("dist"), 8).alias("sim")), 12).collect()]
        assert sim(V.pair_distances(df, "cosine", top=12)) == sim(V.pair_distances(df, "cosine"))
    finally:
        V.block_pairs = blocks
