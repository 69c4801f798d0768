"""Evaluation of segments against ground truth, threshold search and trajectory metrics.

Matching is greedy and one-to-one by definition, so it runs as a fold over the two arrays of a video, which are one row
of a segment document and never larger than that.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions.scalars import temporal_iou
from stridelake.operators.quantiles import group_quantiles
from stridelake.operators.series import finite


# --- boundaries ------------------------------------------------------------------------------------------------------


def boundaries(segments: Column, duration: Column) -> Column:
    """Sorted starts above 0 and ends below the duration of an array of segments; repeats are kept."""
    s = F.filter(F.transform(segments, lambda x: x["start_sec"]), lambda v: v > 0)
    e = F.filter(F.transform(segments, lambda x: x["end_sec"]), lambda v: v < duration)
    return F.array_sort(F.concat(s, e))


def match_boundaries(gt: list[float], pred: list[float], tol: float) -> int:
    """Hits: every true boundary in order takes the nearest unused prediction (the first of equals), if within ``tol``.

    The predictions still free are kept sorted, with their place to tell equals apart, so each boundary looks at its two
    neighbours only.
    """
    free = sorted(zip(pred, range(len(pred))))
    hits = 0
    for g in gt:
        at = bisect_left(free, (g, -1))
        # of equal values below the boundary the first one counts
        near = [(free[at][0] - g, free[at][1], at)] if at < len(free) else []
        if at:
            low = bisect_left(free, (free[at - 1][0], -1))
            near.append((g - free[low][0], free[low][1], low))
        if near and (best := min(near))[0] <= tol:
            del free[best[2]]
            hits += 1
    return hits


def _match(tols: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for u, g, p in zip(*(c.to_pylist() for c in b.columns)):
                out += [(u, t, match_boundaries(g or [], p or [], t), len(g or []), len(p or [])) for t in tols]
            u, t, h, g, p = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(t, pa.float64()), *(pa.array(x, pa.int64()) for x in (h, g, p))], ["unit", "tol", "tp", "n_gt", "n_pred"])

    return run


def f1_at_tolerance(pairs: DataFrame, tols: list[float]) -> DataFrame:
    """``unit, tol, tp, n_gt, n_pred, precision, recall, f1`` for rows of unit, gt and pred (arrays of boundaries).

    Without true boundaries precision is 1 and recall and F1 are 1 if nothing was predicted, else 0.
    """
    m = pairs.select("unit", "gt", "pred").mapInArrow(_match(sorted(set(tols))), "unit string, tol double, tp long, n_gt long, n_pred long")
    none = F.col("n_gt") == 0
    clear = F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)
    p = F.when(none, 1.0).when(F.col("n_pred") == 0, 0.0).otherwise(F.col("tp") / F.col("n_pred"))
    r = F.when(none, clear).otherwise(F.col("tp") / F.nullif(F.col("n_gt"), F.lit(0)))
    m = m.withColumn("precision", p).withColumn("recall", r)
    f = F.when(none, clear).when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return m.withColumn("f1", f)


def macro_average(scores: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Unweighted means over units, missing scores as 0."""
    return scores.groupBy(*keys).agg(*[F.avg(F.coalesce(v, F.lit(0.0))).alias(v) for v in values], F.count("*").alias("n_units"))


# --- detection -------------------------------------------------------------------------------------------------------


def segment_confidence(segments: DataFrame, series: DataFrame, stride: float, fps: float) -> DataFrame:
    """Mean energy of the windows within each segment (closed), else its duration.

    ``segments``: unit, stem, seg_no, start_sec, end_sec. The interval becomes a range of whole windows and is cut into
    cells of 256 windows, so that the join is an equi join on (stem, cell) and no long segment multiplies rows.
    """
    cell = 256
    lo, hi = F.ceil(F.col("start_sec") * fps / stride - 1e-9).cast("long"), F.floor(F.col("end_sec") * fps / stride + 1e-9).cast("long")
    s = segments.withColumn("w0", lo).withColumn("w1", hi)
    cut = s.where("w0 <= w1").withColumn("cell", F.explode(F.sequence(F.floor(F.col("w0") / cell).cast("long"), F.floor(F.col("w1") / cell).cast("long"))))
    e = series.select("stem", "win", "energy").withColumn("cell", F.floor(F.col("win") / cell).cast("long"))
    t = F.col("win") * stride / fps
    hit = cut.join(e, ["stem", "cell"]).where((t >= F.col("start_sec")) & (t <= F.col("end_sec")))
    mean = hit.groupBy("unit", "seg_no").agg(F.avg("energy").alias("mean_energy"))
    return segments.join(mean, ["unit", "seg_no"], "left").withColumn("conf", F.coalesce("mean_energy", F.col("end_sec") - F.col("start_sec")))


def _greedy_iou(thresholds: list[float]):
    """Arrow function (unit, gt, pred): per prediction in order of confidence whether it hits, for each threshold."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for u, gt, pred in zip(*(c.to_pylist() for c in b.columns)):
                start, end = (np.array([g[k] for g in gt or []], float) for k in ("start_sec", "end_sec"))
                free = np.ones((len(thresholds), len(start)), bool)
                for p in pred or []:
                    inter = np.maximum(0.0, np.minimum(p["end_sec"], end) - np.maximum(p["start_sec"], start))
                    iou = inter / np.maximum(1e-8, (p["end_sec"] - p["start_sec"]) + (end - start) - inter)
                    for t, left in zip(thresholds, free):
                        open_ = np.where(left, iou, 0.0)
                        at = int(open_.argmax()) if len(open_) else 0
                        hit = len(open_) > 0 and open_[at] > 0 and bool(open_[at] >= t)
                        if hit:
                            left[at] = False
                        out.append((u, t, p["seg_no"], p["conf"], int(hit)))
            u, t, s, c, h = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(t, pa.float64()), pa.array(s, pa.int64()), pa.array(c, pa.float64()), pa.array(h, pa.int64())], ["unit", "iou", "seg_no", "conf", "tp"])

    return run


def detections(gt: DataFrame, pred: DataFrame, thresholds: list[float]) -> DataFrame:
    """``unit, iou, seg_no, conf, tp``. gt: unit, segs; pred: unit, seg_no, start_sec, end_sec, conf.

    Flags are kept per unit, so greedy matching in each unit by confidence equals the global order. The predictions of
    one unit come from one document.
    """
    p = pred.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct((-F.col("conf")).alias("o"), "seg_no", "start_sec", "end_sec", "conf"))).alias("pred"))
    return gt.join(p, "unit").select("unit", "segs", "pred").mapInArrow(_greedy_iou(thresholds), "unit string, iou double, seg_no long, conf double, tp long")


def average_precision(dets: DataFrame, n_positive: DataFrame, ranges: int = 64) -> DataFrame:
    """``iou, ap``: area under the monotone envelope of precision over recall; without positives 0.

    ``n_positive`` is one row (npos). The ranking over all units is cut into ``ranges`` of the confidence, each ranked by
    a task of its own; counts of the ranges before it and the best precision of those after it (``ranges`` rows per
    threshold) complete the running sums and the envelope.
    """
    cuts = sorted(set(dets.approxQuantile("conf", [i / ranges for i in range(1, ranges)], 1e-3)))
    at = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    d = dets.withColumn("rg", F.size(F.filter(at, lambda c: c > F.col("conf"))))  # 0 holds the highest confidences
    n = d.groupBy("iou", "rg").agg(F.sum("tp").alias("rt"), F.count("*").alias("rk"))
    before = Window.partitionBy("iou").orderBy("rg").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("iou", "rg", F.coalesce(F.sum("rt").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("rk").over(before), F.lit(0)).alias("k0"))
    w = Window.partitionBy("iou", "rg").orderBy(F.desc("conf"), "unit", "seg_no")
    d = d.join(n, ["iou", "rg"]).crossJoin(F.broadcast(n_positive))  # one row
    d = d.withColumn("tpc", F.col("t0") + F.sum("tp").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("precision", F.col("tpc") / (F.col("k0") + F.row_number().over(w)))
    after = Window.partitionBy("iou").orderBy("rg").rowsBetween(1, Window.unboundedFollowing)
    top = d.groupBy("iou", "rg").agg(F.max("precision").alias("best")).select("iou", "rg", F.coalesce(F.max("best").over(after), F.lit(0.0)).alias("later"))
    env = F.greatest(F.max("precision").over(w.rowsBetween(0, Window.unboundedFollowing)), "later")
    d = d.join(top, ["iou", "rg"]).withColumn("envelope", env)
    return d.groupBy("iou").agg(F.coalesce(F.sum(F.try_divide(F.col("tp") * F.col("envelope"), F.col("npos"))), F.lit(0.0)).alias("ap"))


def iou_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """IoU of all overlapping segments of a unit: unit, a_no, b_no, iou."""
    j = a.alias("a").join(b.alias("b"), (F.col("a.unit") == F.col("b.unit")) & (F.col("a.start_sec") < F.col("b.end_sec")) & (F.col("b.start_sec") < F.col("a.end_sec")))
    return j.select(F.col("a.unit").alias("unit"), F.col("a.seg_no").alias("a_no"), F.col("b.seg_no").alias("b_no"), temporal_iou(F.col("a.start_sec"), F.col("a.end_sec"), F.col("b.start_sec"), F.col("b.end_sec")).alias("iou"))


# --- thresholds --------------------------------------------------------------------------------------------------------


def confusion(df: DataFrame, keys: list[str], x: str, label: str, thr: Column) -> DataFrame:
    """tp, tn, fp, fn of ``x > thr`` against a boolean label, with rates (denominators guarded by 1e-12)."""
    p, y = F.col(x) > thr, F.col(label)
    count = lambda c: F.sum(c.cast("long"))
    c = df.groupBy(*keys).agg(count(p & y).alias("tp"), count(~p & ~y).alias("tn"), count(p & ~y).alias("fp"), count(~p & y).alias("fn"))
    return rates(c)


def rates(c: DataFrame) -> DataFrame:
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    c = c.withColumns({"tpr": tp / (tp + fn + 1e-12), "fpr": fp / (fp + tn + 1e-12), "precision": tp / (tp + fp + 1e-12), "acc": (tp + tn) / (tp + tn + fp + fn + 1e-12)})
    return c.withColumn("f1", 2 * F.col("precision") * F.col("tpr") / (F.col("precision") + F.col("tpr") + 1e-12))


def threshold_sweep(df: DataFrame, key: str, x: str, label: str) -> DataFrame:
    """Rates at every distinct value as threshold, in one pass: counts per value, then running sums from above."""
    v = df.groupBy(key, F.col(x).alias("thr")).agg(F.sum(F.col(label).cast("long")).alias("y"), F.count("*").alias("n"))
    every, below = Window.partitionBy(key), Window.partitionBy(key).orderBy("thr").rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumns({"fn": F.sum("y").over(below), "le": F.sum("n").over(below), "ys": F.sum("y").over(every), "ns": F.sum("n").over(every)})
    c = v.select(key, "thr", (F.col("ys") - F.col("fn")).alias("tp"), (F.col("le") - F.col("fn")).alias("tn"), (F.col("ns") - F.col("le") - F.col("ys") + F.col("fn")).alias("fp"), "fn")
    return rates(c)


def best_threshold(sweep: DataFrame, key: str) -> DataFrame:
    """Best by J = tpr - fpr and by F1; among equals (to 1e-9) the smallest value, as candidates ascend."""
    j = F.round(F.col("tpr") - F.col("fpr"), 9)
    best = lambda s: F.max_by(F.struct("thr", "tp", "tn", "fp", "fn", s.alias("score")), F.struct(s, -F.col("thr")))
    b = sweep.groupBy(key).agg(best(j).alias("j"), best(F.round("f1", 9)).alias("f"))
    return b.select(key, F.col("j.thr").alias("thr_j"), F.col("j.score").alias("best_j"), F.col("f.thr").alias("thr_f1"), F.col("f.score").alias("best_f1"))


def candidates(series: DataFrame, quantiles: tuple = (0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """Threshold candidates of each series: quantiles, midpoints between distinct ones, smallest and largest value."""
    s = series.where(finite(F.col("energy")))
    q = s.groupBy("path").agg(F.min("energy").alias("lo"), F.max("energy").alias("hi")).join(group_quantiles(s, ["path"], "energy", list(quantiles)), "path")
    d = q.withColumn("d", F.array_sort(F.array_distinct("q")))
    mids = F.zip_with(F.slice("d", 1, F.size("d") - 1), F.slice("d", 2, F.size("d")), lambda a, b: (a + b) / 2)
    return d.select("path", F.explode(F.array_distinct(F.concat("d", mids, F.array("lo", "hi")))).alias("thr"))


# --- separability --------------------------------------------------------------------------------------------------------


def average_ranks(df: DataFrame, key: str, x: str, out: str) -> DataFrame:
    """1-based ranks, equal values share the mean of theirs; ranked over distinct values only."""
    v = df.groupBy(key, F.col(x).alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn(out, F.sum("_n").over(w) - (F.col("_n") - 1) / 2.0)
    return df.join(v.select(key, F.col("_v").alias(x), out), [key, x])


def roc_auc(df: DataFrame, key: str, x: str, label: str) -> DataFrame:
    """AUC by rank sums; null where a class is missing."""
    r = average_ranks(df, key, x, "rank")
    y = F.col(label)
    a = r.groupBy(key).agg(F.sum(F.when(y, F.col("rank"))).alias("s"), F.sum(y.cast("long")).alias("p"), F.sum((~y).cast("long")).alias("q"))
    return a.select(key, F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * F.col("q")).alias("auc"))


def cohens_d(df: DataFrame, key: str, x: str, label: str) -> DataFrame:
    """Difference of class means over the pooled sample deviation."""
    a, b = F.when(F.col(label), F.col(x)), F.when(~F.col(label), F.col(x))
    s = df.groupBy(key).agg(F.avg(a).alias("m1"), F.avg(b).alias("m0"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v0"), F.count(a).alias("n1"), F.count(b).alias("n0"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / F.nullif(F.col("n1") + F.col("n0") - 2, F.lit(0)))
    return s.select(key, F.try_divide(F.col("m1") - F.col("m0"), F.nullif(pooled, F.lit(0.0))).alias("d"))


def ks_distance(df: DataFrame, key: str, x: str, label: str) -> DataFrame:
    """Largest difference of the classes' distribution functions."""
    v = df.groupBy(key, F.col(x).alias("v")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((~F.col(label)).cast("long")).alias("q"))
    w, every = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key)
    d = F.abs(F.try_divide(F.sum("p").over(w), F.sum("p").over(every)) - F.try_divide(F.sum("q").over(w), F.sum("q").over(every)))
    return v.withColumn("d", d).groupBy(key).agg(F.max("d").alias("ks"))


def quantile_gaps(df: DataFrame, key: str, x: str, label: str) -> DataFrame:
    """``qgap_med``: positive less negative median; ``qgap_90_10``: 90 % quantile of the positives less 10 % quantile of the negatives."""
    a, b = F.when(F.col(label), F.col(x)), F.when(~F.col(label), F.col(x))
    s = df.groupBy(key).agg(F.percentile(a, [0.5, 0.9]).alias("a"), F.percentile(b, [0.5, 0.1]).alias("b"))
    return s.select(key, (F.col("a")[0] - F.col("b")[0]).alias("qgap_med"), (F.col("a")[1] - F.col("b")[1]).alias("qgap_90_10"))


def roc_points(df: DataFrame, key: str, x: str, label: str) -> DataFrame:
    return threshold_sweep(df, key, x, label).select(key, "thr", "fpr", "tpr")


# --- trajectories --------------------------------------------------------------------------------------------------------


def trajectory_errors(pairs: DataFrame, keys: list[str], tol_px: float, size: float) -> DataFrame:
    """MSE, L1 and accuracies of predicted points. ``pairs``: pr, pc (predicted), gr, gc (true), normalised to [-1, 1].

    A coordinate is right within half a pixel; delta AUC averages the accuracy within 1 .. 10 pixels (strict).
    """
    px = 2.0 / size
    dr, dc = F.abs(F.col("pr") - F.col("gr")), F.abs(F.col("pc") - F.col("gc"))
    within = lambda t: (F.sum((dr < t).cast("int")) + F.sum((dc < t).cast("int"))) / (2.0 * F.count("*"))
    auc = sum((within(k * px) for k in range(2, 11)), within(px)) / 10.0
    return pairs.groupBy(*keys).agg((F.sum(dr * dr + dc * dc) / (2.0 * F.count("*"))).alias("mse"), (F.sum(dr + dc) / (2.0 * F.count("*"))).alias("l1"), within(tol_px * px).alias("accuracy"), auc.alias("delta_auc"))


def nonzero_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Shares, accuracy and F1 of 'moves at all' for velocities pv and gv."""
    p, g = F.col("pv") != 0, F.col("gv") != 0
    n = lambda c: F.sum(c.cast("long"))
    a = pairs.groupBy(*keys).agg(F.avg(p.cast("double")).alias("nonzero_pred"), F.avg(g.cast("double")).alias("nonzero_gt"), F.avg((p == g).cast("double")).alias("nonzero_accuracy"), n(p & g).alias("tp"), n(p & ~g).alias("fp"), n(~p & g).alias("fn"))
    return a.withColumn("nonzero_f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))).drop("tp", "fp", "fn")


def cross_track(pred: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """Mean distance of each point of a track to the nearest point of the other track's path (same keys)."""
    j = pred.join(gt, keys).groupBy(*keys, "pt").agg(F.min(F.sqrt(F.pow(F.col("pr") - F.col("gr"), 2) + F.pow(F.col("pc") - F.col("gc"), 2))).alias("d"))
    return j.agg(F.avg("d").alias("cross_track"))
