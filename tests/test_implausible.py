"""The operator for implausible readings against a plain rereading of its rules, and its edge cases."""

import math
import random

import pandas as pd
import pytest

from stridelake.operators import implausible as I

NAN, INF = math.nan, math.inf


def frame(spark, rows):
    cols = "line_id long, path string, win_idx long, energy double, path_copy string"
    return spark.createDataFrame([(*r, None) for r in rows], cols)


def found(df, **kw):
    out = {}
    for r in I.implausible_energy(df, **kw).collect():
        out.setdefault(r["reason"], set()).add(r["rec_id"])
    return out


def brute(rows, ratio=4.0):
    """Spikes and stuck values of one series whose windows are unique and dense, by definition."""
    e = [r[3] for r in rows]
    hit = set()
    for a in range(len(e)):
        for b in range(a, min(a + 3, len(e))):
            left, right = e[max(0, a - 4) : a], e[b + 1 : b + 5]
            if left and right and min(e[a : b + 1]) > ratio * max(left + right):
                hit |= set(range(a, b + 1))
    for a in range(len(e) - 7):
        w = e[a : a + 8]
        if min(w) > 0 and max(w) - min(w) < 0.001 * max(w):
            hit |= set(range(a, a + 8))
    return {rows[i][0] for i in hit}


@pytest.mark.parametrize("seed", range(4))
def test_series_rules_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, want, line = [], set(), 0
    for s in range(6):
        mine = []
        level = rng.random() * 10 + 0.1
        for w in range(rng.randrange(3, 150)):
            x = level * (1 + 0.3 * rng.random())
            if rng.random() < 0.05:
                x *= rng.choice([3, 4.2, 5, 100, 0])
            mine.append([line, f"s{s}", w, x])
            line += 1
        if len(mine) > 60:
            for i in range(30, 30 + rng.choice([7, 8, 12])):
                mine[i][3] = mine[30][3]
        rows += mine
        want |= brute(mine)
    got = found(frame(spark, rows), block=64, gap=2)
    assert got.get("series", set()) == want


def test_cuts_do_not_change_the_result(spark):
    rng = random.Random(9)
    rows = [(i, "hot", i, 1 + rng.random() * 0.3) for i in range(3000)]
    for i in (0, 63, 64, 1000, 1023, 1024, 2999):
        rows[i] = (i, "hot", i, 90.0)
    for i in range(250, 262):
        rows[i] = (i, "hot", i, 1.1)
    small, large = found(frame(spark, rows), block=1024, gap=8), found(frame(spark, rows), block=1 << 14)
    assert small == large and {1000, *range(250, 262)} <= small["series"]


def test_bounds_windows_and_missing(spark):
    rows = [(1, "a", 0, -1.0), (2, "a", 1, INF), (3, "a", 2, NAN), (4, "a", 3, None), (5, "a", -3, 1.0), (6, "a", 50_000_000, 1.0), (7, None, 4, 1.0), (8, "a", None, 1.0), (9, "a", 5, 0.0)]
    got = found(frame(spark, rows))
    assert got == {"bounds": {1, 2}, "window": {5, 6}}


def test_stuck_counter_across_blocks(spark):
    rows = [(i, "a", i, 1.0 + i) for i in range(60)] + [(60 + i, "a", 777, 1.0) for i in range(20)] + [(80 + i, "a", 80 + i, 1.0) for i in range(20)]
    rows += [(200 + i, "b", 5, 1.0) for i in range(5)]
    for block in (4, 8, 64, 1 << 16):
        ids = {r["rec_id"] for r in I.stuck_counter_lines(frame(spark, rows), "path", "line_id", "win_idx", 6, block).collect()}
        assert ids == set(range(60, 80)), block


def test_lines_of_other_files_between(spark):
    rows = [(2 * i, "a", 3 if 5 <= i < 12 else 100 + i, 1.0) for i in range(20)] + [(2 * i + 1, "b", i, 1.0) for i in range(20)]
    ids = {r["rec_id"] for r in I.stuck_counter_lines(frame(spark, rows), "path", "line_id", "win_idx", 6, 8).collect()}
    assert ids == {2 * i for i in range(5, 12)}


def test_repeated_windows(spark):
    # a corrected line does not hide a stuck stretch, and is itself no case
    rows = [(i, "a", i, 2.0 + 0.1 * i) for i in range(30)]
    for i in range(10, 20):
        rows[i] = (i, "a", i, 3.3)
    rows.append((100, "a", 14, 5.0))
    assert found(frame(spark, rows))["series"] == set(range(10, 20))


def test_empty(spark):
    assert found(frame(spark, [])) == {}


def points(spark, rows):
    return spark.createDataFrame(rows, "point_id long, file string, view_name string, t int, h int, n int, pt_row double, pt_col double, vis double, height string")


def test_points(spark):
    files = spark.createDataFrame([("f", "v", 100, None), ("f", "w", 100, 200), ("g", "v", None, None)], "file string, view_name string, height int, width int")
    rows, pid = [], 0
    for t in range(40):
        for h in range(4):
            for n in range(2):
                pid += 1
                rows.append([pid, "f", "v", t, h, n, 50 + 0.3 * (t + h) + n, 60 + 0.2 * (t + h), 0.9, None])
    at = {(r[3], r[4], r[5]): r for r in rows}
    at[5, 2, 0][6] = 90.0  # more than 20 of 100 away
    at[7, 1, 1][7] = 110.0  # more than 40 of 200 away
    at[9, 1, 1][7] = 95.0  # less
    at[11, 0, 0][8], at[12, 0, 0][8], at[13, 0, 0][8] = 1.5, -0.1, NAN
    at[14, 0, 0][6] = None
    stuck = set()
    for t in range(20, 26):
        for h in range(4):
            at[t, h, 1][6:8] = [70.0, 64.0]
            stuck.add(at[t, h, 1][0])
    rows.append([pid + 1, *at[5, 2, 0][1:]])  # a repeated point is judged too
    got = {}
    for r in I.implausible_points(points(spark, [tuple(r) for r in rows]), files).collect():
        got.setdefault(r["reason"], set()).add(r["rec_id"])
    assert got["jump"] == {at[5, 2, 0][0], at[7, 1, 1][0], pid + 1}
    assert got["vis"] == {at[11, 0, 0][0], at[12, 0, 0][0]}
    assert got["stuck"] == stuck
    small = {(r["rec_id"], r["reason"]) for r in I.implausible_points(points(spark, [tuple(r) for r in rows]), files, block=32).collect()}
    assert small == {(i, k) for k, v in got.items() for i in v}


def test_deviation_decides(spark):
    """A point that always moves far is no case; the same distance from a point that stands still is."""
    files = spark.createDataFrame([("f", "v", 100, 100)], "file string, view_name string, height int, width int")
    calm = [(t, "f", "v", t, 0, 0, 50 + 0.1 * t, 50.0 + 0.1 * t, 1.0, None) for t in range(40)]
    calm[20] = (20, "f", "v", 20, 0, 0, 80.0, 52.0, 1.0, None)
    wild = [(100 + t, "f", "v", t, 0, 1, 50 + 30.0 * (t % 3) - 0.1 * t, 50.0 + 0.1 * t, 1.0, None) for t in range(40)]
    got = {r["rec_id"] for r in I.implausible_points(points(spark, calm + wild), files).where("reason = 'jump'").collect()}
    assert got == {20}
    assert len({r["rec_id"] for r in I.implausible_points(points(spark, calm + wild), files, k_mad=0.0).where("reason = 'jump'").collect()}) > 10


def test_window_written_very_often():
    """Context is counted in windows: thousands of lines of one window beside a spike and within a stuck stretch hide nothing."""
    import numpy as np
    import pyarrow as pa

    wins = np.concatenate([np.repeat(np.arange(300), np.where(np.isin(np.arange(300), (99, 203)), 6000, 1))])
    e = 1 + (wins * 7 % 11) * 0.02
    e[wins == 100] = 9.0
    e[(wins >= 200) & (wins < 210)] = 1.5
    p = {"ratio": 4.0, "k_mad": 2.0, "stuck_len": 8, "stuck_tol": 0.001, "gap": 32}
    cols = [np.zeros(len(wins), np.int64), wins, np.arange(len(wins)), e, np.ones(len(wins), bool)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 500]) for c in cols], list("kwlec")) for lo in range(0, len(wins), 500)]
    got = set(np.concatenate([b.column(0).to_numpy() for b in I._series_stream(p, batch=1000)(iter(batches))]))
    assert got == set(np.flatnonzero((wins == 100) | ((wins >= 200) & (wins < 210))))


def test_points_empty(spark):
    files = spark.createDataFrame([], "file string, view_name string, height int, width int")
    assert I.implausible_points(points(spark, []), files).count() == 0


def test_query_on_tables(spark, data):
    from stridelake.plans.implausible import p1_found

    df = p1_found(spark, data)
    assert df.columns == ["tbl", "rec_id"]
    rows = pd.DataFrame(df.collect())
    assert len(rows) and not rows.duplicated().any()
