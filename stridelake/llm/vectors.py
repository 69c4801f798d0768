"""Window and segment vectors of quantised segments, as packed unit vectors.

Vectors travel as ``BINARY`` (float32, unit length), a quarter of the bytes an array of doubles takes. Defined results:
inner vectors that are null, of another length than ``dim``, or hold a null or NaN are left out; a window or segment
without any usable vector has no row, nor has one whose mean is the zero vector; a segment exported repeatedly counts
once; surplus windows without an index, and windows with a null index, are left out of window vectors but count for the
segment; of two windows with the same index the first counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(x: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as a binary column."""
    x = np.ascontiguousarray(x, np.float32)
    n, d = x.shape
    offsets = np.arange(0, (n + 1) * d * 4, d * 4, dtype=np.int32) if d else np.zeros(n + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def unpack(a: pa.Array, dim: int) -> np.ndarray:
    """The matrix of a binary column without nulls."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks() if a.num_chunks != 1 else a.chunk(0)
    if not len(a):
        return np.zeros((0, dim), np.float32)
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.float32, count=(off[-1] - off[0]) // 4, offset=int(off[0])).reshape(len(a), dim)


def _level(a) -> tuple[np.ndarray, pa.Array]:
    """Lengths (0 for null) and values of a list array, whatever its offset."""
    n = len(a)
    off = a.offsets.to_numpy()
    lens = np.diff(off)
    if a.null_count:
        # a null entry may still span values: rebuild without them
        ok = a.is_valid().to_numpy(zero_copy_only=False)
        if (lens[~ok] > 0).any():
            a = pa.concat_arrays([a.take(pa.array(np.arange(n)))])
            off = a.offsets.to_numpy()
            lens = np.diff(off)
    return lens, a.values.slice(int(off[0]), int(off[-1] - off[0])) if n else a.values.slice(0, 0)


def _group_sums(x: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the rows of x by group (``at`` ascending)."""
    count = np.bincount(at, minlength=n)
    out = np.zeros((n, x.shape[1]))
    if len(x):
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[first]] = np.add.reduceat(x, first, axis=0)
    return out, count


def _means(kind: str, dim: int):
    """Arrow function (seg_id, wins, vectors) -> seg_id, win, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nw, windows = _level(b.column(2))
            nv, vectors = _level(windows)
            nx, values = _level(vectors)
            seg_of_win = np.repeat(np.arange(len(nw)), nw)
            win_of_vec = np.repeat(np.arange(len(nv)), nv)
            whole = nx == dim
            x = values.to_numpy(zero_copy_only=False).astype(np.float32)  # a null component reads as NaN
            if not whole.all():
                x = x[np.repeat(whole, nx)]
            x = x.reshape(-1, dim)
            win = win_of_vec[whole]
            good = ~np.isnan(x).any(1) & ~np.isinf(x).any(1)
            x, win = x[good].astype(np.float64), win[good]
            seg_id = b.column(0).to_numpy(zero_copy_only=False)
            if kind == "window":
                s, count = _group_sums(x, win, len(nv))
                place = np.arange(len(nv)) - np.repeat(np.cumsum(nw) - nw, nw)
                ni, idx = _level(b.column(1))
                start = np.cumsum(ni) - ni
                has = place < ni[seg_of_win]
                val = idx.to_numpy(zero_copy_only=False).astype(np.float64)
                at = np.where(has, start[seg_of_win] + place, 0)
                w = np.where(has, val[at] if len(val) else np.nan, np.nan)
                keep = (count > 0) & ~np.isnan(w)
                ids, wins = seg_id[seg_of_win[keep]], w[keep].astype(np.int64)
            else:
                s, count = _group_sums(x, seg_of_win[win], len(nw))
                keep = count > 0
                ids, wins = seg_id[keep], np.zeros(keep.sum(), np.int64)
            mean = s[keep] / count[keep, None]
            norm = np.linalg.norm(mean, axis=1)
            ok = norm > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[ok].astype(np.int64)), pa.array(wins[ok]), pack(mean[ok] / norm[ok, None])], ["seg_id", "win", "v"])

    return run


def unit_vectors(segments: DataFrame, kind: str, dim: int = 64) -> DataFrame:
    """``seg_id, win, v``: the unit vector of every window (``kind`` "window") or segment ("segment", win 0).

    Means are taken where the rows are read, so that one packed vector a window, not all its vectors, is shuffled.
    """
    rows = segments.where("seg_id is not null and quantized_windows is not null").select(
        F.col("seg_id").cast("long").alias("seg_id"), F.coalesce(F.col("selected_win_idxs").cast("array<long>"), F.array().cast("array<long>")).alias("wins"), F.col("quantized_windows").cast("array<array<array<float>>>").alias("q")
    )
    v = rows.mapInArrow(_means(kind, dim), "seg_id long, win long, v binary")
    return v.dropDuplicates(["seg_id", "win"])
