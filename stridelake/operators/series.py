"""Window series: cleaning, de-duplication, alignment, smoothing, resampling, runs and statistics.

A series table has ``path`` (the series), ``win`` and ``energy``. Everything is expressed in built-in functions; the two
recurrences (exponential smoothing here, the state machine in ``segmenter``) stream sorted rows through Arrow with a
constant state, so that no series is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions.scalars import path_source_mode
from stridelake.operators.quantiles import group_quantiles


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def clean_lines(energy: DataFrame, windows: tuple[int, int] | None = None, energies: tuple[float, float] | None = None) -> DataFrame:
    """Lines with a usable energy and window: path, win, energy, line_id.

    ``windows`` and ``energies`` are bounds (closed) outside of which lines are left out; by default there are none.
    """
    e = energy.where(F.col("path").isNotNull() & finite(F.col("energy")) & F.col("win_idx").isNotNull())
    for name, bounds in (("energy", energies), ("win_idx", windows)):
        if bounds is not None:
            e = e.where(F.col(name).between(*bounds))
    return e.select("path", F.col("win_idx").cast("long").alias("win"), "energy", "line_id")


def named(series: DataFrame) -> DataFrame:
    """With ``stem``, ``source`` and ``mode``, which the path names."""
    at = path_source_mode(F.col("path"))
    return series.select("*", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("stem"), at["source"].alias("source"), at["mode"].alias("mode"))


def keep_per_window(lines: DataFrame, which: str = "last") -> DataFrame:
    """One row per window: the last or the first line, named.

    Only fixed-width values are aggregated, by hash and before the shuffle, so a repeated window is no hot spot.
    """
    pick = F.max_by if which == "last" else F.min_by
    return named(lines.groupBy("path", "win").agg(pick("energy", "line_id").alias("energy")))


def by_window(*keys: str):
    return Window.partitionBy(*(keys or ("path",))).orderBy("win")


def positions(series: DataFrame) -> DataFrame:
    """``i``: the place of each window in its series, from 0."""
    return series.withColumn("i", (F.row_number().over(by_window()) - 1).cast("long"))


def resolve_source(lines: DataFrame) -> DataFrame:
    """Source and mode of every file: the first non-null in file order, else what the path names."""
    at = path_source_mode(F.col("path"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_id")))
    f = lines.where("path is not null").groupBy("path").agg(first("source").alias("source"), first("mode").alias("mode"))
    return f.select("path", F.coalesce("source", at["source"]).alias("source"), F.coalesce("mode", at["mode"]).alias("mode"))


# --- alignment -----------------------------------------------------------------------------------------------------


def align(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Windows present in both series: ``a`` and ``b`` hold the energies."""
    return a.select(*on, F.col("energy").alias("a")).join(b.select(*on, F.col("energy").alias("b")), on)


def align_all(series: DataFrame, group: str, member: str) -> DataFrame:
    """Rows whose window is present in every member of the group; if none is, the rows as they are."""
    n = F.size(F.collect_set(member))
    members = series.groupBy(group).agg(F.count_distinct(member).alias("n_all"))
    common = series.groupBy(group, "win").agg(F.count_distinct(member).alias("n")).join(members, group).where("n = n_all").select(group, "win")
    has = common.groupBy(group).agg(F.lit(True).alias("has"))
    del n
    marked = series.join(common.withColumn("common", F.lit(True)), [group, "win"], "left").join(has, group, "left")
    return marked.where(F.col("common") | F.col("has").isNull()).drop("common", "has")


# --- smoothing and resampling ---------------------------------------------------------------------------------------


def _ema_stream(alpha: float):
    """Arrow function (path, win, energy), sorted: adds ``ema``; the state is one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, 0.0
        for b in batches:
            keys = b.column(0).to_pylist()
            out = []
            for k, x in zip(keys, b.column(2).to_pylist()):
                y = x if k != last else alpha * x + (1 - alpha) * y
                last = k
                out.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["path", "win", "ema"])

    return run


def ema(series: DataFrame, alpha: float = 0.4) -> DataFrame:
    """``path, win, ema``: y0 = x0, y = alpha x + (1 - alpha) y; alpha is cut to [0, 1], a non-finite one is 0.4."""
    alpha = min(1.0, max(0.0, alpha)) if np.isfinite(alpha) else 0.4
    s = series.select("path", F.col("win").cast("long").alias("win"), F.col("energy").cast("double").alias("energy"))
    return s.repartition("path").sortWithinPartitions("path", "win").mapInArrow(_ema_stream(alpha), "path string, win long, ema double")


def moving_average(series: DataFrame, w: int) -> DataFrame:
    """Causal mean of the last ``w`` windows present; fewer at the start."""
    return series.withColumn("ma", F.avg("energy").over(by_window().rowsBetween(-(max(1, w) - 1), 0)))


def stride_mean(series: DataFrame, stride: int) -> DataFrame:
    """Mean of every ``stride`` consecutive windows, the last group may be shorter."""
    p = positions(series)
    return p.groupBy("path", F.floor(F.col("i") / max(1, stride)).cast("long").alias("g")).agg(F.avg("energy").alias("energy"))


def paa(series: DataFrame, n: int) -> DataFrame:
    """Means of ``n`` equal parts of a series; one not longer than ``n`` stays as it is."""
    size = F.count("*").over(Window.partitionBy("path"))
    p = positions(series).withColumn("size", size)
    bucket = F.when(F.col("size") <= n, F.col("i")).otherwise(F.floor(F.col("i") * n / F.col("size")))
    return p.groupBy("path", bucket.cast("long").alias("bucket")).agg(F.avg("energy").alias("energy"))


def every_nth(series: DataFrame, fps: float, target: float) -> DataFrame:
    """Integer-step resampling: every round(fps / target)-th place."""
    return positions(series).where(F.col("i") % max(1, round(fps / target)) == 0)


def resample_ticks(series: DataFrame, fps: float, target: float) -> DataFrame:
    """Time-based resampling: the first place at or after each tick of 1 / target seconds."""
    p = positions(series).withColumn("tick", F.floor(F.col("i") * target / fps + 1e-6).cast("long"))
    new = F.coalesce(F.col("tick") > F.lag("tick").over(by_window()), F.lit(True))
    return p.withColumn("new", new).where("new").drop("new")


def interpolate(series: DataFrame, m: int) -> DataFrame:
    """``m`` values at even distances over each series, both ends kept, linear in between: ``path, j, value``."""
    p = positions(series)
    n = p.groupBy("path").agg(F.count("*").alias("n"))
    t = n.select("path", "n", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j")).withColumn("x", F.col("j") * (F.col("n") - 1) / F.lit(float(max(1, m - 1))))
    t = t.withColumn("lo", F.floor("x").cast("long")).withColumn("hi", F.least(F.ceil("x").cast("long"), F.col("n") - 1))
    v = p.select("path", "i", "energy")
    t = t.join(v.select("path", F.col("i").alias("lo"), F.col("energy").alias("a")), ["path", "lo"]).join(v.select("path", F.col("i").alias("hi"), F.col("energy").alias("b")), ["path", "hi"])
    return t.select("path", F.col("j").cast("long").alias("j"), (F.col("a") + (F.col("b") - F.col("a")) * (F.col("x") - F.col("lo"))).alias("value"))


HALO = 1200  # (2 - sqrt(3)) ** HALO is below the smallest double over the largest


def spline(series: DataFrame, m: int, block: int = 16_384) -> DataFrame:
    """``path, j, value``: not-a-knot cubic spline through each series at ``m`` even places.

    A spline couples all points of its series, but with every place a point's influence on the curvature falls to
    2 - sqrt(3) of itself: beyond ``HALO`` places no double is left of it. So a long series is solved in blocks with a
    halo that makes the result independent of the cut, and no task holds more than a block.
    """

    def one(key, pdf):
        import pandas as pd

        path, at = key
        pdf = pdf.sort_values("i")
        first, last, end = int(pdf["i"].iloc[0]), int(pdf["i"].iloc[-1]), int(pdf["n"].iloc[0]) - 1
        x = np.linspace(0, end, m)
        j = np.flatnonzero(np.clip(np.floor(x), 0, max(end - 1, 0)) // block == at)
        value = _not_a_knot(pdf["energy"].to_numpy(), x[j] - first, (first > 0, last < end)) if len(j) else np.zeros(0)
        return pd.DataFrame({"path": path, "j": j, "value": value})

    p = positions(series.select("path", "win", "energy")).withColumn("n", F.count("*").over(Window.partitionBy("path")))
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("i") - HALO) / block)), F.least(F.floor((F.col("n") - 1) / block), F.floor((F.col("i") + HALO) / block)))
    return p.select("path", "i", "n", "energy", F.explode(near).alias("at")).groupBy("path", "at").applyInPandas(one, "path string, j long, value double")


def _not_a_knot(y: np.ndarray, x: np.ndarray, cut: tuple[bool, bool] = (False, False)) -> np.ndarray:
    """Values at x of the cubic spline through (0, y0), (1, y1), ...; fewer than four points: their polynomial.

    ``cut``: whether the series goes on before the first and after the last point; x is to be ``HALO`` away from there.
    """
    n = len(y)
    if n < 4:
        return np.polyval(np.polyfit(np.arange(n), y, n - 1), x)
    # second derivatives m: m[i-1] + 4 m[i] + m[i+1] = 6 (y[i-1] - 2 y[i] + y[i+1]); ends: third derivative continuous, where cut 0
    r = 6 * (y[:-2] - 2 * y[1:-1] + y[2:])
    lower, main, upper = np.ones(n - 2), np.full(n - 2, 4.0), np.ones(n - 2)
    # m0 = 2 m1 - m2 and its mirror image put in
    if not cut[0]:
        main[0], upper[0] = 6.0, 0.0
    if not cut[1]:
        main[-1], lower[-1] = 6.0, 0.0
    c, d = np.zeros(n - 2), np.zeros(n - 2)
    c[0], d[0] = upper[0] / main[0], r[0] / main[0]
    for i in range(1, n - 2):
        q = main[i] - lower[i] * c[i - 1]
        c[i], d[i] = upper[i] / q, (r[i] - lower[i] * d[i - 1]) / q
    m = np.zeros(n)
    m[n - 2] = d[-1]
    for i in range(n - 4, -1, -1):
        m[i + 1] = d[i] - c[i] * m[i + 2]
    m[0] = 0.0 if cut[0] else 2 * m[1] - m[2]
    m[-1] = 0.0 if cut[1] else 2 * m[-2] - m[-3]
    k = np.clip(np.floor(x).astype(int), 0, n - 2)
    t = x - k
    return (1 - t) * y[k] + t * y[k + 1] + ((1 - t) ** 3 - (1 - t)) * m[k] / 6 + (t**3 - t) * m[k + 1] / 6


# --- differences, runs, slices ---------------------------------------------------------------------------------------


def differences(series: DataFrame) -> DataFrame:
    """First difference from the window before; the first has none."""
    return series.withColumn("diff", F.col("energy") - F.lag("energy").over(by_window()))


def cumulative(diffs: DataFrame, start: str = "start", diff: str = "diff") -> DataFrame:
    """Values rebuilt from a start and the differences."""
    return diffs.withColumn("value", F.col(start) + F.sum(F.coalesce(F.col(diff), F.lit(0.0))).over(by_window().rowsBetween(Window.unboundedPreceding, 0)))


def runs(series: DataFrame) -> DataFrame:
    """Stretches of windows that follow each other by 1: ``path, start_win, end_win, n``."""
    island = F.col("win") - F.row_number().over(by_window())
    return series.withColumn("island", island).groupBy("path", "island").agg(F.min("win").alias("start_win"), F.max("win").alias("end_win"), F.count("*").alias("n")).drop("island")


def longest_run(series: DataFrame) -> DataFrame:
    """The longest stretch of each series, the first of equals."""
    best = F.max_by(F.struct("start_win", "end_win", "n"), F.struct(F.col("n"), -F.col("start_win")))
    return runs(series).groupBy("path").agg(best.alias("r")).select("path", "r.*")


def pick_run(series: DataFrame, length: int, seed: int = 42) -> DataFrame:
    """A stretch of at least ``length`` windows by seeded hash, else the longest."""
    long = F.when(F.col("n") >= length, F.xxhash64("path", "start_win", F.lit(seed)))
    best = F.max_by(F.struct("start_win", "end_win", "n"), F.struct(F.col("n") >= length, long, F.col("n"), -F.col("start_win")))
    return runs(series).groupBy("path").agg(best.alias("r")).select("path", "r.*")


def time_slice(series: DataFrame, start_sec: float, end_sec: float, stride: float, fps: float) -> DataFrame:
    """Windows within a time range, with their time."""
    lo, hi = round(start_sec * fps / stride), round(end_sec * fps / stride)
    return series.where(F.col("win").between(lo, hi)).withColumn("sec", F.col("win") * stride / fps)


def axis_fps(series: DataFrame, durations: DataFrame, stride: float, fps: float, slack: float = 5.0) -> DataFrame:
    """The frame rate at which the windows fill the known duration, where the given one is off by more than ``slack`` s."""
    m = series.groupBy("path").agg(F.max("win").alias("max_win")).join(durations, "path")
    off = F.abs(F.col("max_win") * stride / fps - F.col("duration_sec")) > slack
    return m.select("path", F.when(off & (F.col("duration_sec") > 0), F.col("max_win") / F.col("duration_sec") * stride).otherwise(F.lit(float(fps))).alias("fps"))


# --- statistics ------------------------------------------------------------------------------------------------------

QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9]


def describe(series: DataFrame, keys: list[str], value: str = "energy") -> DataFrame:
    """n, mean, population deviation, extremes and exact quantiles of the finite values."""
    s = series.where(finite(F.col(value)))
    names = ["q10", "q25", "q50", "q75", "q90"]
    a = s.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    a = a.join(group_quantiles(s, keys, value, QUANTILES), keys)
    return a.select(*keys, "n", "mean", "std", "min", "max", *[F.col("q")[i].alias(c) for i, c in enumerate(names)])


def otsu(series: DataFrame, keys: list[str], value: str = "energy", bins: int = 256) -> DataFrame:
    """Otsu's threshold of each group: the centre of the first of ``bins`` that maximises the between-class variance."""
    r = series.where(finite(F.col(value))).groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = series.where(finite(F.col(value))).join(r, keys)
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0).cast("long")
    h = x.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("c"))
    dense = r.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))).join(h, [*keys, "bin"], "left").fillna(0, ["c"])
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    o = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    d = dense.withColumn("centre", centre).withColumn("cx", F.col("c") * F.col("centre"))
    d = d.withColumns({"w0": F.sum("c").over(o), "s0": F.sum("cx").over(o), "w": F.sum("c").over(every), "s": F.sum("cx").over(every)})
    w1 = F.col("w") - F.col("w0")
    diff = F.try_divide("s0", "w0") - F.try_divide(F.col("s") - F.col("s0"), w1)
    d = d.withColumn("var", F.coalesce(F.col("w0") * w1 * diff * diff, F.lit(0.0)))
    best = F.max_by("centre", F.struct(F.round("var", 6), -F.col("bin")))
    return d.groupBy(*keys).agg(F.when(F.first("hi") == F.first("lo"), F.first("lo")).otherwise(best).alias("threshold"))


def histogram(df: DataFrame, keys: list[str], value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of equal bins over [lo, hi], the upper end included; values outside are left out."""
    b = F.least(F.lit(bins - 1), F.floor((value - lo) / (hi - lo) * bins)).cast("long")
    return df.where(value.between(lo, hi)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
