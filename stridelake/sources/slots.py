"""Places where a model or a reader of raw media is plugged in.

The engine does not decode video or run neural networks. A slot takes batches of windows and returns their results with
a fixed schema; ``FakeEncoder`` is a deterministic stand-in for tests. A slot that fails on a window gives a row with an
error text and nulls instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WINDOW_RESULT = "path string, win long, codes array<int>, energy double, error string"


class WindowModel(Protocol):
    """Turns the frames' features of one window into codes and an energy."""

    def __call__(self, features: np.ndarray) -> tuple[list[int], float]: ...


class FakeEncoder:
    """Codes from the signs of the features, energy from their mean length."""

    def __init__(self, n_codes: int = 14):
        self.n_codes = n_codes

    def __call__(self, features: np.ndarray) -> tuple[list[int], float]:
        x = np.atleast_2d(features)
        codes = [int((x[:, i % x.shape[1]] > 0).sum()) for i in range(self.n_codes)]
        return codes, float(np.linalg.norm(x, axis=1).mean())


def encode_windows(windows: DataFrame, make_model: Callable[[], WindowModel], gate: str | None = None) -> DataFrame:
    """``path, win, codes, energy, error`` for rows of path, win and features (array of arrays).

    The model is made once a task. ``gate`` names a boolean column: gated windows skip the model and get energy 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if gate is not None and getattr(r, gate):
                    out.append((r.path, r.win, None, 0.0, None))
                    continue
                try:
                    codes, e = model(np.array([np.asarray(v, dtype=float) for v in r.features]))
                    out.append((r.path, r.win, codes, e, None))
                except Exception as x:  # a bad window must not end the job
                    out.append((r.path, r.win, None, None, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(out, columns=["path", "win", "codes", "energy", "error"])

    return windows.mapInPandas(run, WINDOW_RESULT)


class TracksSource(DataSource):
    """Template of a reader for track tensors: one partition per file, rows in the form of the ``tracks`` table.

    Options: ``files`` (comma-separated) and ``reader`` is given by subclassing ``load``; HDF5 support needs a library
    that is imported only when a partition is read.
    """

    @classmethod
    def name(cls) -> str:
        return "track_tensors"

    def schema(self) -> str:
        return "file string, view_name string, t int, h int, n int, pt_row double, pt_col double, vis double"

    def reader(self, schema) -> DataSourceReader:
        return _TracksReader(self.options)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _TracksReader(DataSourceReader):
    def __init__(self, options):
        self.files = [f for f in options.get("files", "").split(",") if f]

    def partitions(self):
        return [_File(f) for f in self.files] or [_File("")]

    def read(self, partition: _File):
        if not partition.path:
            return
        if partition.path.endswith(".npz"):
            views = np.load(partition.path)
            names = sorted({k.rsplit("/", 1)[0] for k in views.files})
            get = lambda v, k: views[f"{v}/{k}"]
        else:
            import h5py

            f = h5py.File(partition.path, "r")
            names = sorted(f["root"])
            get = lambda v, k: f[f"root/{v}/{k}"][()]
        for v in names:
            tracks, vis = get(v, "tracks"), get(v, "vis")
            for t in range(tracks.shape[0]):
                for h in range(tracks.shape[1]):
                    for n in range(tracks.shape[2]):
                        yield (partition.path, v, t, h, n, float(tracks[t, h, n, 0]), float(tracks[t, h, n, 1]), float(vis[t, h, n]))


class DemosSource(DataSource):
    """Template of a reader for demonstration files: one partition per file, one row per step of a demonstration.

    Reads ``.npz`` files with ``demo_k/actions``, ``demo_k/joint_states`` and ``demo_k/gripper_states``; other formats
    subclass the reader. Images stay where they are; ``proprio`` is joints followed by grippers.
    """

    @classmethod
    def name(cls) -> str:
        return "demo_steps"

    def schema(self) -> str:
        return "file string, demo string, t int, action array<double>, proprio array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _DemosReader(self.options)


class _DemosReader(DataSourceReader):
    def __init__(self, options):
        self.files = [f for f in options.get("files", "").split(",") if f]

    def partitions(self):
        return [_File(f) for f in self.files] or [_File("")]

    def read(self, partition: _File):
        if not partition.path:
            return
        z = np.load(partition.path)
        for demo in sorted({k.split("/")[0] for k in z.files}):
            actions = z[f"{demo}/actions"]
            parts = [z[f"{demo}/{k}"] for k in ("joint_states", "gripper_states") if f"{demo}/{k}" in z.files]
            for t in range(len(actions)):
                yield (partition.path, demo, t, [float(x) for x in actions[t]], [float(x) for p in parts for x in np.atleast_1d(p[t])])
