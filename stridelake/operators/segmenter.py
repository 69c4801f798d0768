"""The hysteresis state machine that cuts a series into segments.

``Step`` is the only implementation of the machine; the batch operator streams sorted rows through it and the streaming
processor in ``stridelake.streaming`` keeps it as state, so both give the same segments. Two variants exist on purpose:

* ``batch``: the activating window does not count towards the length; the end test (value below ``on * ratio`` for
  ``down`` windows) comes before the length cap; leaving resets both counters.
* ``stream``: the activating window counts; the cap is tested first; a running cooldown is never shortened.

A segment starts at the window that confirms activation. Starting is ``>=``, ending is strictly ``<``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    on: float
    ratio: float = 0.9
    up: int = 2
    down: int = 2
    cooldown: int = 1
    max_windows: int = 0
    mode: str = "batch"

    @property
    def off(self) -> float:
        return self.on * self.ratio


class Step:
    """State of one series; ``feed`` takes the next value and gives the segment it closes, if any."""

    __slots__ = ("rule", "active", "pos", "neg", "cool", "start", "length", "last")

    def __init__(self, rule: Rule, state: tuple | None = None):
        self.rule = rule
        self.active, self.pos, self.neg, self.cool, self.start, self.length, self.last = state or (False, 0, 0, 0, -1, 0, -1)

    def state(self) -> tuple:
        return self.active, self.pos, self.neg, self.cool, self.start, self.length, self.last

    def feed(self, i: int, x: float) -> tuple[int, int, int] | None:
        """(start, end, windows counted) of a segment that ends at place i."""
        r = self.rule
        self.last = i
        if self.cool > 0:
            self.cool -= 1
        if not self.active:
            self.pos = self.pos + 1 if x >= r.on else 0
            if self.cool or self.pos < max(1, r.up):
                return None
            self.active, self.start, self.length, self.pos, self.neg = True, i, 0, 0, 0
            if r.mode == "batch":
                return None
        self.length += 1
        full = r.max_windows > 0 and self.length >= r.max_windows
        if r.mode == "batch" or not full:
            self.neg = self.neg + 1 if x < r.off else 0
        if not full and self.neg < max(1, r.down):
            return None
        out = (self.start, i, self.length)
        self.active = False
        if r.mode == "batch":
            self.cool, self.length, self.pos, self.neg = r.cooldown, 0, 0, 0
        else:
            self.cool = max(self.cool, r.cooldown)
        return out

    def flush(self) -> tuple[int, int, int] | None:
        """The segment still open at the end."""
        if not self.active:
            return None
        self.active = False
        return self.start, self.last, self.length


def _fold(rule: Rule):
    """Arrow function over rows sorted by key: segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for b in batches:
            out: list[tuple] = []
            for k, i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if k != key:
                    if step is not None and (s := step.flush()):
                        out.append((key, *s))
                    key, step = k, Step(rule)
                if s := step.feed(i, x):
                    out.append((k, *s))
            yield _rows(out)
        if step is not None and (s := step.flush()):
            yield _rows([(key, *s)])

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    k, s, e, n = zip(*out) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(n, pa.int64())], ["path", "i0", "i1", "windows"])


def segment(series: DataFrame, rule: Rule, value: str = "energy", min_len: int = 0) -> DataFrame:
    """``path, i0, i1, windows``: segments as first and last place, of at least ``min_len`` places.

    ``series`` has ``path``, ``i`` and the value. Rows are partitioned by series and streamed in order; the state is a
    handful of numbers, so a long series needs no more memory than a short one.
    """
    s = series.select("path", F.col("i").cast("long").alias("i"), F.col(value).cast("double").alias("x"))
    out = s.repartition("path").sortWithinPartitions("path", "i").mapInArrow(_fold(rule), "path string, i0 long, i1 long, windows long")
    length = F.col("i1") - F.col("i0") + 1 if rule.mode == "batch" else F.col("windows")
    return out.where(length >= max(min_len, 0))


def segment_many(series: DataFrame, ons: list[float], value: str = "energy") -> DataFrame:
    """``path, on, i0, i1, windows``: the segments of every series at each of some thresholds, in one pass over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, steps = None, []

        def rows(out):
            cols = list(zip(*out)) if out else ((),) * 5
            return pa.RecordBatch.from_arrays([pa.array(z, t) for z, t in zip(cols, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))], ["path", "on", "i0", "i1", "windows"])

        for b in batches:
            out: list[tuple] = []
            for k, i, x in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    out += [(key, on, *s) for on, step in zip(ons, steps) if (s := step.flush())]
                    key, steps = k, [Step(Rule(on)) for on in ons]
                out += [(k, on, *s) for on, step in zip(ons, steps) if (s := step.feed(i, x))]
            yield rows(out)
        yield rows([(key, on, *s) for on, step in zip(ons, steps) if (s := step.flush())])

    s = series.select("path", F.col("i").cast("long").alias("i"), F.col(value).cast("double").alias("x"))
    return s.repartition("path").sortWithinPartitions("path", "i").mapInArrow(run, "path string, on double, i0 long, i1 long, windows long")


def ema_segments(series: DataFrame, alpha: float, rule: Rule) -> DataFrame:
    """Smoothing and state machine in one pass over the sorted rows."""

    def run(batches):
        key, step, y = None, None, 0.0
        for b in batches:
            out: list[tuple] = []
            for k, i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if k != key:
                    if step is not None and (s := step.flush()):
                        out.append((key, *s))
                    key, step, y = k, Step(rule), x
                else:
                    y = alpha * x + (1 - alpha) * y
                if s := step.feed(i, y):
                    out.append((k, *s))
            yield _rows(out)
        if step is not None and (s := step.flush()):
            yield _rows([(key, *s)])

    s = series.select("path", F.col("i").cast("long").alias("i"), F.col("energy").cast("double").alias("x"))
    return s.repartition("path").sortWithinPartitions("path", "i").mapInArrow(run, "path string, i0 long, i1 long, windows long")


def to_seconds(segments: DataFrame, dt: float) -> DataFrame:
    """``start_sec``, ``end_sec`` (end exclusive) from places."""
    return segments.withColumn("start_sec", F.col("i0") * dt).withColumn("end_sec", (F.col("i1") + 1) * dt)


def max_windows(seconds: float, stride: float, fps: float, mode: str = "batch") -> int:
    """The cap in windows of a duration."""
    if seconds <= 0:
        return 0
    return round(seconds / (stride / fps)) if mode == "batch" else int(max(1, round(seconds * max(1.0, fps / stride))))


def start_frame(win_start: Column, win_end: Column, how: str, t: int, stride: int) -> Column:
    """First frame of a segment from its first window: ``center``, ``end`` or ``start`` of the window."""
    return {"center": win_start + t // 2, "end": win_end - stride + 1, "start": win_start}[how]


def segment_times(start: Column, end: Column, fps: float) -> Column:
    n = end - start + 1
    return F.struct((start / fps).alias("start_sec"), (start / fps + n / fps).alias("end_sec"), n.alias("n_frames"))


def frame_windows(frames: Column, t: int, stride: int, phase: int = 1) -> Column:
    """Windows over a stream of frames: struct(win, first frame, last frame); phase 1 is online, 0 offline."""
    n = F.floor((frames - t) / stride).cast("long") + (1 if phase == 0 else 0)
    at = lambda w: F.struct(w.alias("win"), (w * stride + phase).alias("ws"), (w * stride + phase + t - 1).alias("we"))
    return F.when(n < 1, F.array().cast("array<struct<win:bigint,ws:bigint,we:bigint>>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), at))


def export_windows(segments: DataFrame, windows: DataFrame, t: int, ratio: float, drop_at_or_below: int = 0) -> DataFrame:
    """Windows of each segment that overlap it by at least ``ratio`` of their length.

    ``segments``: seg_id, path, start_frame, end_frame (-1: open); ``windows``: path, win, ws, we. Both are cut into
    stretches of ``t`` frames, which makes the overlap an equi join with at most two candidates a window.
    """
    lo = F.when(F.col("start_frame") < 0, 0).otherwise(F.col("start_frame"))
    last = windows.groupBy("path").agg(F.max("we").alias("last_frame"))
    s = segments.join(last, "path").withColumn("lo", lo).withColumn("hi", F.when(F.col("end_frame") < 0, F.col("last_frame")).otherwise(F.least("end_frame", "last_frame")))
    s = s.where("lo <= hi").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / t).cast("long"), F.floor(F.col("hi") / t).cast("long"))))
    w = windows.withColumn("cell", F.explode(F.array_distinct(F.array(F.floor(F.col("ws") / t).cast("long"), F.floor(F.col("we") / t).cast("long")))))
    over = F.greatest(F.lit(0), F.least("we", "hi") - F.greatest("ws", "lo") + 1)
    hit = s.join(w, ["path", "cell"]).withColumn("overlap", over).where((F.col("overlap") > 0) & (F.col("overlap") / F.lit(float(t)) >= ratio))
    hit = hit.groupBy("seg_id", "path", "win", "ws", "we").agg(F.max("overlap").alias("overlap"))
    if drop_at_or_below:
        n = hit.groupBy("seg_id").agg(F.count("*").alias("n")).where(F.col("n") > drop_at_or_below)
        hit = hit.join(n.select("seg_id"), "seg_id", "left_semi")
    return hit


def non_overlapping(windows: DataFrame) -> DataFrame:
    """Greedy choice per segment: by start, a window is taken if it begins after the last one taken ended.

    The windows of a segment arrive sorted and are streamed; the state is the end of the last one taken.
    """

    def run(batches):
        key, end = None, -1
        for b in batches:
            keep = []
            for k, s, e in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if k != key:
                    key, end = k, -1
                keep.append(s > end)
                if s > end:
                    end = e
            yield b.filter(pa.array(keep, pa.bool_()))

    w = windows.select("seg_id", "win", "ws", "we")
    return w.repartition("seg_id").sortWithinPartitions("seg_id", "ws", "win").mapInArrow(run, w.schema)
