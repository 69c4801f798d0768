import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stridelake.llm import sequences as Q

SEG = "seg_id long, codes_windows array<array<int>>, selected_win_idxs array<int>, win_geom struct<t:int,stride:int,target_fps:int>, exported_at timestamp, term string"


def segments(spark, rows):
    import datetime

    t0 = datetime.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, c, w, (15, 4, 10), None if d is None else t0 + datetime.timedelta(days=d), "x") for i, c, w, d in rows], SEG)


def test_code_sequences(spark):
    rows = [
        (1, [[1, 2], [3]], [7, 5], 0), (1, [[1, 2], [3]], [7, 5], 3),  # windows out of order, exported twice
        (2, [[1], None, [2, None]], [4, 3, 9], None), (3, None, None, 0), (4, [], [], 0),
        (5, [[8], [9]], [2], 0),  # a window without an index comes last
        (None, [[1]], [1], 0),
    ]
    got = {r["seg_id"]: (r["seq"], r["wins"]) for r in Q.code_sequences(segments(spark, rows)).collect()}
    assert got == {1: ([3, 1, 2], [5, 7, 7]), 2: ([1, 2, None], [4, 9, 9]), 3: ([], []), 4: ([], []), 5: ([8, 9], [2, None])}
    assert Q.code_sequences(segments(spark, [])).count() == 0


def runs(seq, tol, least):
    out, s = [], 0
    for i in range(1, len(seq) + 1):
        if i == len(seq) or seq[i] is None or seq[i - 1] is None or abs(seq[i] - seq[i - 1]) > tol:
            if i - s >= least:
                out.append((s, i - s))
            s = i
    return out


def test_runs_equal_loop(spark):
    rng = random.Random(4)
    data = {i: [rng.choice([1, 2, 3, 9, None]) for _ in range(rng.randrange(0, 40))] for i in range(60)} | {99: [5] * 5000}
    df = spark.createDataFrame([(i, s) for i, s in data.items()], "seg_id long, seq array<int>")
    got = {}
    df = df.select("seg_id", F.posexplode("seq").alias("pos", "code"), (F.col("pos") * 2).alias("t"))
    for r in Q.collapse_runs(df, ["seg_id"], ["pos"], "code", "t", tol=1).where("run_len >= 3").collect():
        assert r["duration"] == 2 * (r["run_len"] - 1) == r["end_time"] - r["start_time"] and r["value"] == data[r["seg_id"]][r["start_pos"]]
        got.setdefault(r["seg_id"], set()).add((r["start_pos"], r["run_len"]))
    assert got == {i: set(v) for i, s in data.items() if (v := runs(s, 1, 3))}


@pytest.mark.parametrize("block", [None, 1, 7])
def test_runs_of_rows(spark, block):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([1.0, 1.0, 2.0, 8.0]), i * 0.5) for k in range(4) for i in range(50)] + [(9, i, 3.0, i * 0.5) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, i long, v double, t double")
    if block:
        df = df.withColumn("cut", F.floor(F.col("i") / block))
    got = {(r["k"], r["start_time"], r["end_time"], r["run_len"]) for r in Q.collapse_runs(df, ["k"], ["i"], "v", "t", tol=1.0, block="cut" if block else None).collect()}
    want = set()
    for k in {r[0] for r in rows}:
        seq = [r[2] for r in rows if r[0] == k]
        want |= {(k, s * 0.5, (s + n - 1) * 0.5, n) for s, n in runs(seq, 1, 1)}
    assert got == want


def test_term_counts(spark):
    rng = random.Random(6)
    data = [[rng.randrange(-3, 20) for _ in range(rng.randrange(0, 30))] for _ in range(200)] + [[None, 1, None], [], None, [7] * 1000]
    df = spark.createDataFrame([(d, 1) for d in data], "t array<int>, term int").repartition(5)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in Q.term_counts(df, "t").collect()}
    occ, rec = Counter(), Counter()
    for d in data:
        d = [x for x in d or [] if x is not None]
        occ.update(d), rec.update(set(d))
    assert got == {k: (occ[k], rec[k]) for k in occ}
    assert Q.term_counts(df.limit(0), "t").count() == 0


def test_term_counts_flush(spark, monkeypatch):
    import pyarrow as pa

    b = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([[i, i + 1]], pa.list_(pa.int64()))], ["r", "t"]) for i in range(100)]
    out = Counter()
    for r in Q._counters(flush=10)(iter(b)):
        for t, o in zip(r.column(0).to_pylist(), r.column(1).to_pylist()):
            out[t] += o
    assert out[0] == 1 and out[50] == 2 and sum(out.values()) == 200


@pytest.mark.parametrize("flush", [3, 1 << 20])
def test_records_cut_over_rows(spark, flush):
    """A record in several rows, over batches and hand-overs, is one record: the last one seen decides."""
    import pyarrow as pa

    rng = random.Random(9)
    data = [(r, [rng.randrange(12) for _ in range(rng.randrange(0, 9))]) for r in sorted(rng.randrange(40) for _ in range(300))]
    occ, of = Counter(), {}
    for r, ts in data:
        occ.update(ts)
        for t in ts:
            of.setdefault(t, set()).add(r)
    want = {t: (occ[t], len(of[t])) for t in occ}
    got: dict = {}
    batches = [pa.RecordBatch.from_arrays([pa.array([r for r, _ in data[lo : lo + 7]]), pa.array([t for _, t in data[lo : lo + 7]], pa.list_(pa.int64()))], ["r", "t"]) for lo in range(0, len(data), 7)]
    for b in Q._counters(flush=flush)(iter(batches)):
        for t, o, r in zip(*(c.to_pylist() for c in b.columns)):
            got[t] = tuple(x + y for x, y in zip(got.get(t, (0, 0)), (o, r)))
    assert got == want
    df = spark.createDataFrame([*data, (None, [1])], "rec long, t array<int>").repartition(6)
    assert {r["term"]: (r["occurrences"], r["records"]) for r in Q.term_counts(df, "t", "rec").collect()} == want


def test_marks(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 40), (4, 41)], "term long, records long")
    assert {r["term"]: r["mark"] for r in Q.mark_terms(df, F.lit(100), 2, 0.4).collect()} == {1: "rare", 2: None, 3: None, 4: "common"}


def brute_patterns(data, support, lo, hi, gap):
    count = Counter()
    for s in data:
        seen, level = set(), {((c,), i) for i, c in enumerate(s) if c is not None}
        for n in range(2, hi + 1):
            level = {((*p, s[j]), j) for p, i in level for j in range(i + 1, min(i + gap + 1, len(s))) if s[j] is not None and s[j] not in p}
            if n >= lo:
                seen |= {p for p, _ in level}
        count.update(seen)
    return {p: n for p, n in count.items() if n >= support}


@pytest.mark.parametrize("seed", range(3))
def test_patterns_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [[rng.choice([*range(6), None]) for _ in range(rng.randrange(0, 16))] for _ in range(40)]
    df = spark.createDataFrame([(d,) for d in data] + [(None,)], "s array<int>")
    got = {tuple(r["pattern"]): r["support"] for r in Q.frequent_subsequences(df, "s", min_support=6).collect()}
    assert got == brute_patterns(data, 6, 3, 5, 4)


def test_patterns_of_empty_and_long(spark):
    df = spark.createDataFrame([(None,)], "s array<int>")
    assert Q.frequent_subsequences(df.limit(0), "s", min_support=1).count() == 0
    long = spark.createDataFrame([(list(itertools.chain.from_iterable([1, 9, 2, 9, 3] for _ in range(2000))),)], "s array<int>")
    assert (1, 2, 3) in {tuple(r["pattern"]) for r in Q.frequent_subsequences(long, "s", min_support=1, max_len=3).collect()}
