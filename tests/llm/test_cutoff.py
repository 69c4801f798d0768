import math
import random

import pytest
from pyspark.sql import functions as F

from stridelake.llm import cutoff


def exact(xs, pct):
    xs = sorted((x for x in xs if x is not None and x == x and 0 <= x < math.inf), reverse=True)
    k = math.ceil(len(xs) * pct / 100 - 1e-9)
    return xs[max(k, 1) - 1] if xs else None


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "id long, s string, e double, source string")


@pytest.mark.parametrize("seed", range(5))
def test_equals_sorting(spark, seed):
    rng = random.Random(seed)
    rows, targets = [], {}
    for k in range(12 if seed % 2 else 4):
        n = rng.choice([1, 2, 7, 300])
        kind = rng.randrange(4)
        for _ in range(n):
            x = [rng.random(), rng.choice([0.0, 1.0, 2.0]), math.exp(rng.gauss(0, 8)), 5.0][kind]
            rows.append((len(rows), f"s{k}", rng.choice([x, x, x, None, math.nan, math.inf, -1.0])))
        targets[f"s{k}"] = rng.choice([1, 10, 50, 90, 100])
    df = frame(spark, rows)
    got = cutoff.score_cutoffs(df, F.col("s"), F.col("e"), targets)
    for s, pct in targets.items():
        want = exact([r[2] for r in rows if r[1] == s], pct)
        assert (got[s][0] if s in got else None) == want
    kept = {r["id"] for r in cutoff.keep_fraction(df, F.col("s"), F.col("e"), targets).collect()}
    assert kept == {i for i, s, e in rows if s in got and e is not None and e == e and 0 <= e < math.inf and e >= got[s][0]}
    assert {s: got[s][1] for s in got} == {s: sum(1 for i, t, _ in rows if t == s and i in kept) for s in got}


def test_neighbouring_floats(spark):
    x = 1.0
    rows = []
    for i in range(100):
        rows.append((i, "a", x))
        x = math.nextafter(x, 2)
    assert cutoff.score_cutoffs(frame(spark, rows), F.col("s"), F.col("e"), {"a": 37})["a"] == (rows[63][2], 37, 100)


def test_targets_and_empty(spark):
    df = frame(spark, [(1, "a", 1.0), (2, "a", 2.0), (3, None, 5.0)])
    assert cutoff.score_cutoffs(df, F.col("s"), F.col("e"), {"a": 0, "b": 10, "c": None}) == {}
    assert cutoff.keep_fraction(df, F.col("s"), F.col("e"), {"a": 100}).count() == 2
    assert cutoff.keep_fraction(df, F.col("s"), F.col("e"), {}).count() == 0
    empty = frame(spark, [])
    assert cutoff.keep_fraction(empty, F.col("s"), F.col("e"), {"a": 50}).count() == 0
    assert cutoff.cutoff_report(empty, F.col("s"), F.col("e"), {"a": 50}).count() == 0
    assert cutoff.keep_fraction(df, F.col("s"), F.col("e"), {"a": 50}).columns == df.columns


def test_passes_are_few(spark):
    rng = random.Random(0)
    xs = [math.exp(rng.gauss(0, 1)) for _ in range(20000)] + [1e12]
    df = frame(spark, [(i, "a", x) for i, x in enumerate(xs)]).select(F.col("s").alias("source"), F.col("e").alias("x"))
    src = cutoff._Source(len(xs), min(xs), max(xs), sum(xs), 25)
    assert cutoff._passes(df, {"a": src}) <= 10
    assert src.cutoff == exact(xs, 25)
