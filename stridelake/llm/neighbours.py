"""The most similar windows of other segments for every window, by the inverted multi-index of ``multi_index``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm import multi_index
from stridelake.llm.vectors import unit_vectors
from stridelake.sources.tables import materialise


def similar_windows(segments: DataFrame, *, top: int = 5, least: float = 0.9, dim: int = 64, reach: int = 128) -> DataFrame:
    """``seg_a, win_a, seg_b, win_b, cosine`` with seg_a < seg_b, each pair once.

    The cosine is at least ``least`` and one of the two is among the other's ``top`` most similar windows of other
    segments; equal similarities are ordered by the place of the windows in the written table. Windows without a usable
    vector take no part.
    """
    v = unit_vectors(segments, "window", dim).withColumnRenamed("seg_id", "seg").sortWithinPartitions("seg", "win")
    v = materialise(v.select(F.monotonically_increasing_id().alias("id"), "seg", "win", "v"), "windows")  # written once, so the ids stay
    q = multi_index.fit(v, v.count(), dim)
    best = multi_index.nearest(v, q, dim=dim, top=top, least=least, reach=reach)
    pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("cosine"))
    names = v.select("id", "seg", "win")
    out = pairs.join(names.select(F.col("id").alias("a"), F.struct("seg", "win").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.struct("seg", "win").alias("y")), "b")
    lo, hi = F.least("x", "y"), F.greatest("x", "y")
    return out.select(lo["seg"].alias("seg_a"), lo["win"].alias("win_a"), hi["seg"].alias("seg_b"), hi["win"].alias("win_b"), "cosine")
