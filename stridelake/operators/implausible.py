"""Readings that cannot be true: spikes, stuck values and values outside physical bounds.

Two kinds of sources are covered: scalar series in windows (``implausible_energy``) and point tracks
(``implausible_points``).

Scalar series. A series is one file (``path``). Rows are sorted by window and streamed through a Hampel filter (rolling
median and median absolute deviation over the window and four to either side); its candidates are then tested exactly:
a stretch of at most three windows counts if each of its windows exceeds ``ratio`` times everything in the four windows
before and the four after it. Stuck values are runs of at least ``stuck_len`` windows whose non-zero values differ by
less than ``stuck_tol``; stuck counters are runs of at least ``stuck_counter`` lines in file order with one window
index. Values that are negative or infinite and windows outside ``0..max_window`` are out of bounds.

Scale. No series is ever held by one task: series are cut into blocks of ``block`` windows that carry ``halo`` windows of
context from either neighbour, so a file that holds a third of all rows is spread over many tasks. Two energies that lie
more than ``gap`` windows apart are not neighbours, which makes the halo exact for any cut. Stuck counters are found as
runs within blocks of lines; only the first and last run of each block are compared across blocks.

Defined results: null and NaN energies are no cases and are skipped as if absent; 0.0 is normal; a null window or file
name takes no part in order-based rules; windows written repeatedly contribute all their lines (a stuck value is looked
for in the first-written and in the last-written line of each window); spikes need a neighbour on both sides; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDE = 4  # windows looked at on either side
MAX_STRETCH = 3


def _shift(x: np.ndarray, k: int, fill: float) -> np.ndarray:
    """x moved so that place i holds x[i + k]."""
    out = np.full(len(x), fill)
    if k >= 0:
        out[: len(x) - k] = x[k:]
    else:
        out[-k:] = x[:k]
    return out


def _hampel(m: np.ndarray, piece: np.ndarray, k_mad: float) -> np.ndarray:
    """Places above the rolling median by ``k_mad`` scaled deviations; places with a cut-off frame are candidates too."""
    n = len(m)
    w = 2 * SIDE + 1
    out = np.ones(n, bool)
    if n < w:
        return out
    frames = np.lib.stride_tricks.sliding_window_view(m, w)
    mid = slice(SIDE, n - SIDE)
    whole = piece[: n - w + 1] == piece[w - 1 :]
    # a place not above every neighbour divided by... can only be a spike if it exceeds its frame's median
    med = np.partition(frames, SIDE, axis=1)[:, SIDE]
    hot = np.flatnonzero(whole & (m[mid] > med))
    dev = np.partition(np.abs(frames[hot] - med[hot, None]), SIDE, axis=1)[:, SIDE]
    flag = ~whole
    flag[hot] = m[mid][hot] - med[hot] > k_mad * 1.4826 * dev
    out[mid] = flag
    return out


def _spike_bound(m: np.ndarray, piece: np.ndarray, ratio: float, k_mad: float) -> np.ndarray:
    """For each window the energy above which its lines are spikes; infinite where there is none."""
    n = len(m)
    bound = np.full(n, np.inf)
    cand = np.flatnonzero(_hampel(m, piece, k_mad))
    if not len(cand):
        return bound
    reach = MAX_STRETCH - 1 + SIDE
    near = np.full((len(cand), 2 * reach + 1), np.nan)
    for c, k in enumerate(range(-reach, reach + 1)):
        at = cand + k
        ok = (at >= 0) & (at < n)
        at = np.clip(at, 0, n - 1)
        near[:, c] = np.where(ok & (piece[at] == piece[cand]), m[at], np.nan)
    filled = np.nan_to_num(near, nan=-1.0)
    for a in range(MAX_STRETCH):
        for b in range(MAX_STRETCH - a):
            lo, hi = reach - a, reach + b
            left, right = filled[:, lo - SIDE : lo].max(1), filled[:, hi + 1 : hi + 1 + SIDE].max(1)
            top = np.maximum(left, right)
            inner = near[:, lo : hi + 1]
            with np.errstate(invalid="ignore"):
                ok = (left >= 0) & (right >= 0) & (inner > ratio * top[:, None]).all(1)
            bound[cand[ok]] = np.minimum(bound[cand[ok]], ratio * top[ok])
    return bound


def _stuck(v: np.ndarray, piece: np.ndarray, length: int, tol: float) -> np.ndarray:
    """Places within ``length`` consecutive non-zero values that differ by less than ``tol``."""
    n = len(v)
    out = np.zeros(n, bool)
    if n < length:
        return out
    f = np.lib.stride_tricks.sliding_window_view(v, length)
    lo, hi = f.min(1), f.max(1)
    ok = np.flatnonzero((lo > 0) & (hi - lo < tol * hi) & (piece[: n - length + 1] == piece[length - 1 :]))
    for k in range(length):
        out[ok + k] = True
    return out


def _series_cases(key, win, line, e, p: dict) -> np.ndarray:
    """Mask of the lines (sorted by key, win, line) that are spikes or stuck."""
    n = len(e)
    if not n:
        return np.zeros(0, bool)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (win[1:] != win[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n) - 1
    of = np.cumsum(new) - 1
    k, w = key[start], win[start]
    cut = np.ones(len(start), bool)
    cut[1:] = (k[1:] != k[:-1]) | (w[1:] - w[:-1] > p["gap"])
    piece = np.cumsum(cut)
    out = e > _spike_bound(np.maximum.reduceat(e, start), piece, p["ratio"], p["k_mad"])[of]
    for at in (start, end):
        v = e[at]
        hit = _stuck(v, piece, p["stuck_len"], p["stuck_tol"])
        out |= hit[of] & (np.abs(e - v[of]) < p["stuck_tol"] * np.maximum(e, v[of])) & (e > 0)
    return out


def _series_stream(p: dict, keep: int = 64, batch: int = 1 << 14):
    """Arrow function over rows sorted by (key, block, win, line).

    Lines are decided once ``keep`` further windows (more than any rule looks at) follow; as many decided windows are
    held back as context. Memory is bounded by a batch and the lines of these windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = None  # lines held back: context and those not decided yet
        fresh = 0  # of these, so many from the front were emitted already

        def emit(cols, lo, hi):
            mask = _series_cases(cols[0], cols[1], cols[2], cols[3], p)
            pick = np.flatnonzero(mask[lo:hi] & cols[4][lo:hi]) + lo
            return pa.RecordBatch.from_arrays([pa.array(cols[2][pick])], ["rec_id"])

        for b in batches:
            new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cols = new if cols is None else [np.concatenate(x) for x in zip(cols, new)]
            n = len(cols[0])
            if n - fresh < batch:
                continue
            start = np.flatnonzero(np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))
            if len(start) <= keep or start[-keep] <= fresh:
                continue
            upto = int(start[-keep])
            yield emit(cols, fresh, upto)
            cut = int(start[max(0, len(start) - 2 * keep)])
            cols, fresh = [x[cut:] for x in cols], upto - cut
        if cols is not None:
            yield emit(cols, fresh, len(cols[0]))

    return run


def _series_key(c: Column) -> Column:
    """64-bit hash of the file name; two of ten million names share one with a chance of 3e-6."""
    return F.xxhash64(c)


def stuck_counter_lines(df: DataFrame, series: str, line: str, counter: str, min_len: int, block: int = 1 << 16) -> DataFrame:
    """``rec_id`` of the lines in runs of at least ``min_len`` equal ``counter`` values, by ``line`` within ``series``.

    Runs are found within blocks of ``block`` line numbers; a run that touches a block's end is joined with its
    continuation through a table of at most two runs per series and block.
    """
    rows = df.select(_series_key(F.col(series)).alias("k"), F.col(line).cast("long").alias("rec_id"), F.col(counter).cast("long").alias("c")).where(
        F.col(series).isNotNull() & F.col("rec_id").isNotNull()
    )
    rows = rows.withColumn("blk", F.floor(F.col("rec_id") / F.lit(block)).cast("long"))
    w = Window.partitionBy("k", "blk").orderBy("rec_id")
    prev = F.lag("c").over(w)
    rows = rows.withColumn("new", (F.row_number().over(w) == 1) | ~F.coalesce(F.col("c") == prev, F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("k", "blk", "run").agg(F.first("c").alias("c"), F.count("*").alias("n"), F.min("rec_id").alias("lo"), F.max("rec_id").alias("hi"))
    b = Window.partitionBy("k", "blk")
    runs = runs.withColumn("last", F.col("run") == F.max("run").over(b)).withColumn("first", F.col("run") == 1)
    sure = runs.where(F.col("c").isNotNull() & (F.col("n") >= min_len)).select("k", "lo", "hi")
    # a block's inner runs are whole; ends are chained over the blocks of a series
    ends = runs.where(F.col("c").isNotNull() & (F.col("first") | F.col("last")))
    o = Window.partitionBy("k").orderBy("blk", "run")
    joined = ends.withColumn("joins", F.coalesce((F.lag("c").over(o) == F.col("c")) & F.lag("last").over(o) & F.col("first") & (F.lag("blk").over(o) != F.col("blk")), F.lit(False)))
    joined = joined.withColumn("chain", F.sum((~F.col("joins")).cast("int")).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    chained = joined.groupBy("k", "chain").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    long = sure.union(chained.where((F.col("parts") > 1) & (F.col("n") >= min_len)).select("k", "lo", "hi"))
    # back to the lines: stretches are cut into the same blocks, so the join key is never hotter than a block
    cuts = long.withColumn("blk", F.explode(F.sequence(F.floor(F.col("lo") / F.lit(block)).cast("long"), F.floor(F.col("hi") / F.lit(block)).cast("long"))))
    return rows.select("k", "blk", "rec_id").join(cuts, ["k", "blk"]).where(F.col("rec_id").between(F.col("lo"), F.col("hi"))).select("rec_id").distinct()


def implausible_energy(
    df: DataFrame,
    *,
    series: str = "path",
    line: str = "line_id",
    window: str = "win_idx",
    value: str = "energy",
    ratio: float = 4.0,
    k_mad: float = 2.0,
    stuck_len: int = 8,
    stuck_tol: float = 0.001,
    stuck_counter: int = 6,
    max_window: int = 49_000_000,
    gap: int = 32,
    block: int = 1 << 14,
) -> DataFrame:
    """``rec_id`` (the line) and ``reason`` (bounds, window, series, counter) of every line that cannot be true.

    ``k_mad`` must not exceed 2.02 (the largest value for which a window that is ``ratio`` = 4 times its neighbours is
    certain to be a candidate of the Hampel filter).
    """
    value_c, win_c = F.col(value).cast("double"), F.col(window).cast("long")
    inf = float("inf")
    base = df.select(_series_key(F.col(series)).alias("k"), F.col(line).cast("long").alias("rec_id"), win_c.alias("win"), value_c.alias("e"), F.col(series).isNotNull().alias("has"))
    bounds = base.where(F.col("e").isNotNull() & ~F.isnan("e") & ((F.col("e") < 0) | (F.col("e") == inf))).select("rec_id", F.lit("bounds").alias("reason"))
    window_bad = base.where((F.col("win") < 0) | (F.col("win") > max_window)).select("rec_id", F.lit("window").alias("reason"))

    halo = gap * max(stuck_len, 2 * SIDE + MAX_STRETCH)
    good = base.where(
        F.col("has") & F.col("rec_id").isNotNull() & F.col("e").isNotNull() & ~F.isnan("e") & (F.col("e") >= 0) & (F.col("e") < inf) & F.col("win").between(0, max_window)
    )
    home, pos = F.floor(F.col("win") / F.lit(block)).cast("long"), F.col("win") % block
    blocks = F.array_compact(F.array(home, F.when((pos < halo) & (home > 0), home - 1), F.when(pos >= block - halo, home + 1)))
    spread = good.withColumn("home", home).withColumn("blk", F.explode(blocks))
    sorted_ = (
        spread.withColumn("core", F.col("home") == F.col("blk"))
        .withColumn("k", F.xxhash64("k", "blk"))  # one key for series and block
        .select("k", "win", "rec_id", "e", "core")
        .repartition(F.col("k"))
        .sortWithinPartitions("k", "win", "rec_id")
    )
    p = {"ratio": ratio, "k_mad": k_mad, "stuck_len": stuck_len, "stuck_tol": stuck_tol, "gap": gap}
    found = sorted_.mapInArrow(_series_stream(p), "rec_id long").select("rec_id", F.lit("series").alias("reason"))
    counter = stuck_counter_lines(df, series, line, window, stuck_counter).select("rec_id", F.lit("counter").alias("reason"))
    return bounds.unionByName(window_bad).unionByName(found).unionByName(counter)


def _sizes(files: DataFrame) -> DataFrame:
    """height and width of every (file, view_name); unknown ones from the file's other views, else the usual size."""
    f = files.select("file", "view_name", F.when(F.col("height") > 0, F.col("height")).alias("h"), F.when(F.col("width") > 0, F.col("width")).alias("w"))
    f = f.groupBy("file", "view_name").agg(F.max("h").alias("h"), F.max("w").alias("w"))
    by_file = Window.partitionBy("file")
    f = f.withColumn("h", F.coalesce("h", F.max("h").over(by_file))).withColumn("w", F.coalesce("w", F.max("w").over(by_file)))
    usual = f.where(F.col("h").isNotNull() & F.col("w").isNotNull()).agg(F.mode(F.struct("h", "w")).alias("u"))
    mate_w = f.where("h is not null and w is not null").groupBy("h").agg(F.mode("w").alias("mw"))
    mate_h = f.where("h is not null and w is not null").groupBy("w").agg(F.mode("h").alias("mh"))
    f = f.join(mate_w, "h", "left").join(mate_h, "w", "left").join(F.broadcast(usual), F.lit(True), "left")  # one row
    return f.select("file", "view_name", F.coalesce("h", "mh", "u.h").alias("height"), F.coalesce("w", "mw", "u.w").alias("width"))


def implausible_points(tracks: DataFrame, files: DataFrame, *, share: float = 0.2, k_mad: float = 2.0, stuck_t: int = 5, frames: int = 3, block: int = 128) -> DataFrame:
    """``rec_id`` (the point) and ``reason`` (vis, jump, stuck) of every track point that cannot be true.

    Hampel filter: a point jumps when it lies more than ``share`` of the frame's height or width, and more than ``k_mad``
    scaled median absolute deviations, from the rolling median of the same point's places within ``frames`` frames; it is
    stuck when one place is held unchanged over at least ``stuck_t``
    starts in a row. A point's rows are cut into blocks of ``block`` starts with a halo. Null coordinates and null vis
    are no cases; a frame of unknown size takes that of the file's other view, of frames with the same known side, or
    the most usual one; repeated points are all judged.
    """
    vis = tracks.where(~F.isnan("vis") & ((F.col("vis") < 0) | (F.col("vis") > 1))).select(F.col("point_id").alias("rec_id"), F.lit("vis").alias("reason"))
    halo = 2 * frames + 8 + stuck_t
    pts = tracks.where("file is not null and pt_row is not null and pt_col is not null and t is not null").select(
        F.xxhash64("file", "view_name").alias("k"), F.col("n").cast("long").alias("n"), F.col("t").cast("long").alias("t"), (F.col("t") + F.coalesce("h", F.lit(0))).cast("long").alias("fr"), "pt_row", "pt_col", F.col("point_id").alias("rec_id")
    )
    home, pos = F.floor(F.col("t") / F.lit(block)).cast("long"), F.pmod(F.col("t"), F.lit(block))
    blocks = F.array_compact(F.array(home, F.when(pos < halo, home - 1), F.when(pos >= block - halo, home + 1)))
    pts = pts.withColumn("home", home).withColumn("blk", F.explode(blocks)).withColumn("p", F.xxhash64("k", "n", "blk")).withColumn("core", F.col("home") == F.col("blk"))
    pts = pts.select("p", "k", "t", "fr", "pt_row", "pt_col", "rec_id", "core").repartition("p")
    near = Window.partitionBy("p").orderBy("fr").rangeBetween(-frames, frames)

    middle = lambda a: F.get(F.sort_array(a), F.floor(F.size(a) / 2).cast("int"))
    moved = pts.withColumns({"ar": F.collect_list("pt_row").over(near), "ac": F.collect_list("pt_col").over(near)}).where("core")
    moved = moved.withColumns({"mr": middle(F.col("ar")), "mc": middle(F.col("ac"))}).withColumns({"dr": F.abs(F.col("pt_row") - F.col("mr")), "dc": F.abs(F.col("pt_col") - F.col("mc"))})
    moved = moved.where(F.greatest("dr", "dc") > 1.0)
    sizes = _sizes(files).select(F.xxhash64("file", "view_name").alias("k"), "height", "width")

    def outlier(d: str, size: str, a: str, m: str) -> Column:
        """Beyond the share of the frame, and beyond ``k_mad`` scaled deviations of the place's own movement."""
        # the median is bound once, not worked out anew for every place
        mad = F.get(F.transform(F.array(m), lambda mid: middle(F.transform(F.col(a), lambda x: F.abs(x - mid)))), F.lit(0))
        return (F.col(d) > share * F.col(size)) & (F.col(d) > k_mad * 1.4826 * mad)

    jump = moved.join(sizes, "k").where(outlier("dr", "height", "ar", "mr") | outlier("dc", "width", "ac", "mc")).select("rec_id", F.lit("jump").alias("reason"))
    # stuck: starts at which a place was held, numbered among the starts of the point
    by_t = Window.partitionBy("p").orderBy("t")
    held = pts.withColumn("tn", F.dense_rank().over(by_t))
    place = Window.partitionBy("p", "pt_row", "pt_col").orderBy("tn")
    held = held.withColumn("new", F.coalesce(F.col("tn") - F.lag("tn").over(place) > 1, F.lit(True)).cast("int"))
    held = held.withColumn("run", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("p", "pt_row", "pt_col", "run")
    stuck = held.withColumn("len", F.max("tn").over(whole) - F.min("tn").over(whole) + 1).where(F.col("core") & (F.col("len") >= stuck_t)).select("rec_id", F.lit("stuck").alias("reason"))
    return vis.unionByName(jump).unionByName(stuck)


def implausible(energy: DataFrame, tracks: DataFrame, files: DataFrame) -> DataFrame:
    """``tbl, rec_id`` of all cases in both tables, each once."""
    e = implausible_energy(energy).select(F.lit("energy").alias("tbl"), "rec_id")
    t = implausible_points(tracks, files).select(F.lit("tracks").alias("tbl"), "rec_id")
    return e.unionByName(t).where(F.col("rec_id").isNotNull()).distinct()
