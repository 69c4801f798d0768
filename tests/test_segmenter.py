"""Golden series, the fold against a plain loop, and streaming against batch."""

import math
import random

import pandas as pd
import pytest

from stridelake.operators import segmenter as G
from stridelake.operators import series as S

GOLDEN = [
    ("simple", [0, 12, 12, 12, 0, 0, 0], 0, [(2, 5)], [(2, 5)]),
    ("spike", [0, 12, 0, 0], 0, [], []),
    ("held open", [12, 12, 9.5, 9.5, 0, 0], 0, [(1, 5)], [(1, 5)]),
    ("open at end", [0, 12, 12, 12], 0, [(2, 3)], [(2, 3)]),
    ("equality starts", [10, 10, 0, 0], 0, [(1, 3)], [(1, 3)]),
    ("cap", [12] * 8, 3, [(1, 4), (6, 7)], [(1, 3), (5, 7)]),
]


def fold(values, rule):
    step, out = G.Step(rule), []
    for i, x in enumerate(values):
        if s := step.feed(i, x):
            out.append(s[:2])
    if s := step.flush():
        out.append(s[:2])
    return out


@pytest.mark.parametrize("name,values,cap,batch,stream", GOLDEN)
def test_golden(name, values, cap, batch, stream):
    assert fold(values, G.Rule(on=10, max_windows=cap)) == batch
    assert fold(values, G.Rule(on=10, max_windows=cap, mode="stream")) == stream


def series_frame(spark, data: dict[str, list[float]]):
    rows = [(p, i, float(x)) for p, xs in data.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["path", "win", "energy"]))


def test_fold_equals_loop(spark):
    rng = random.Random(1)
    data = {f"s{k}": [rng.choice([0, 5, 9.5, 12]) * rng.random() * 1.5 for _ in range(rng.randrange(1, 80))] for k in range(30)}
    for mode in ("batch", "stream"):
        rule = G.Rule(on=6, max_windows=7, mode=mode)
        got = {}
        for r in G.segment(S.positions(series_frame(spark, data)), rule).collect():
            got.setdefault(r["path"], []).append((r["i0"], r["i1"]))
        want = {k: v for k, xs in data.items() if (v := fold(xs, rule))}
        assert {k: sorted(v) for k, v in got.items()} == want


def test_ema(spark):
    got = {r["win"]: r["ema"] for r in S.ema(series_frame(spark, {"a": [1, 2, 3]}), 0.5).collect()}
    assert got == {0: 1.0, 1: 1.5, 2: 2.25}
    assert [r["ema"] for r in S.ema(series_frame(spark, {"a": [1.0]}), math.nan).collect()] == [1.0]


def test_ema_and_machine_in_one_pass(spark):
    rng = random.Random(2)
    df = S.positions(series_frame(spark, {f"s{k}": [rng.random() * 3 for _ in range(60)] for k in range(8)}))
    rule = G.Rule(on=1.6)
    one = {tuple(r) for r in G.ema_segments(df, 0.6, rule).collect()}
    e = S.ema(df, 0.6).join(df.select("path", "win", "i"), ["path", "win"])
    assert one == {tuple(r) for r in G.segment(e, rule, value="ema").collect()}


def test_streaming_equals_batch(spark, tmp_path):
    from stridelake.streaming import segmenter as T

    rng = random.Random(3)
    rows = [(f"s{k}", w, rng.random() * 3, k * 1000 + w) for k in range(3) for w in range(60)]
    for part in range(3):  # arrival in three files, each in any order
        chunk = [r for r in rows if r[1] // 20 == part]
        rng.shuffle(chunk)
        pd.DataFrame(chunk, columns=["path", "win", "energy", "line_id"]).to_parquet(tmp_path / f"part{part}.parquet")
        # file age decides the order in which a stream reads files
        import os

        os.utime(tmp_path / f"part{part}.parquet", (1_700_000_000 + part, 1_700_000_000 + part))
    rule = G.Rule(on=1.2, mode="stream", max_windows=9)
    stream = T.segments(T.read_energy(spark, str(tmp_path), max_files=1), rule, alpha=0.7, min_windows=3)
    T.run_once(stream, str(tmp_path / "ck"), str(tmp_path / "out"))
    got = {(r["path"], r["i0"], r["i1"]) for r in spark.read.schema(T.OUT).json(str(tmp_path / "out")).collect()}
    df = S.positions(spark.createDataFrame(pd.DataFrame(rows, columns=["path", "win", "energy", "line_id"])))
    want = {(r["path"], r["i0"], r["i1"]) for r in G.ema_segments(df, 0.7, rule).where("windows >= 3").collect()}
    # the batch also closes what is open at the end; the stream does so at its timeout
    assert got <= want and all(r[2] == 59 for r in want - got)


def test_empty(spark):
    none = spark.createDataFrame([], "path string, win long, energy double")
    assert G.segment(S.positions(none), G.Rule(on=1)).count() == 0
    assert S.ema(none, 0.5).count() == 0
