"""Structured Streaming: energies in, closed segments out, with the same step function as the batch operator.

State per series: the smoothed value and the machine's counters, a dozen numbers, whatever the length of the series. It
is keyed by the window index, not by arrival count, so a dropped line cannot shift later segments. Lines of one
micro-batch are put in order; a line for a window already passed is late and ignored (the first line of a window counts).
A series that is idle for ``timeout`` gets its open segment closed (end of stream) and its state dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stridelake.operators.segmenter import Rule, Step

OUT = "path string, i0 long, i1 long, windows long"
STATE = "active boolean, pos long, neg long, cool long, start long, length long, last long, y double"


def _processor(rule: Rule, alpha: float | None, min_windows: int, timeout_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            step = Step(rule, state.get[:7])
            state.remove()
            s = step.flush()
            out = [(key[0], *s)] if s and s[2] >= min_windows else []
            yield pd.DataFrame(out, columns=["path", "i0", "i1", "windows"])
            return
        old = state.get if state.exists else None
        step, y = Step(rule, tuple(old[:7]) if old else None), old[7] if old else None
        rows = pd.concat(list(batches)).sort_values(["win", "line_id"], kind="stable")
        out = []
        for w, e in zip(rows["win"].tolist(), rows["energy"].tolist()):
            if w <= step.last or e != e:
                continue
            y = e if y is None or alpha is None else alpha * e + (1 - alpha) * y
            if (s := step.feed(w, y)) and s[2] >= min_windows:
                out.append((key[0], *s))
        state.update((*step.state(), float(y) if y is not None else 0.0))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["path", "i0", "i1", "windows"])

    return run


def segments(lines: DataFrame, rule: Rule, *, alpha: float | None = None, min_windows: int = 3, timeout_ms: int = 0) -> DataFrame:
    """Segments of a stream of ``path, win, energy, line_id``; rows without a number are ignored.

    With a batch frame this would be ``operators.segmenter.segment``; ``i0`` and ``i1`` are window indices here.
    """
    rows = lines.where(F.col("path").isNotNull() & F.col("win").isNotNull() & F.col("energy").isNotNull()).select("path", F.col("win").cast("long").alias("win"), F.col("energy").cast("double").alias("energy"), F.col("line_id").cast("long").alias("line_id"))
    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("path").applyInPandasWithState(_processor(rule, alpha, min_windows, timeout_ms), OUT, STATE, "append", kind)


def window_rates(lines: DataFrame, delay: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Lines and mean energy per minute of writing and series, late lines accepted up to ``delay``."""
    return lines.withWatermark("written_at", delay).groupBy(F.window("written_at", width), "path").agg(F.count("*").alias("n"), F.avg("energy").alias("mean"))


def read_energy(spark, path: str, max_files: int = 8) -> DataFrame:
    """A folder of parquet files as a stream; ``max_files`` per micro-batch is the back-pressure."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_once(stream: DataFrame, checkpoint: str, out: str) -> None:
    """Work off everything that is there, exactly once, as JSON lines."""
    q = stream.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
