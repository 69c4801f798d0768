"""Exact quantiles (linear interpolation) per group, also for groups that no task could hold.

Spark's ``percentile`` keeps every distinct value of a group in one task. That is right for many small groups; a group of
more than ``hot_rows`` rows is selected in parts instead: a mergeable sketch gives up to ``cuts`` cut points of the
group, rows are counted between them, and only the rows of the few intervals that hold a wanted rank are ranked, each
interval by a task of its own. The sketch decides how much is ranked, never what comes out. Values equal to a cut
belong to the interval above it; counts per value come first, so that a value repeated without end is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _plain(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    return df.groupBy(*keys).agg(F.percentile(value, qs).alias("q"))


def _selected(df: DataFrame, keys: list[str], value: str, qs: list[float], cuts: int) -> DataFrame:
    counts = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    at = df.groupBy(*keys).agg(F.percentile_approx(value, [i / cuts for i in range(1, cuts)], 10 * cuts).alias("at"), F.count("*").alias("n"))
    at = at.withColumn("at", F.array_distinct("at"))
    placed = counts.join(at, keys).withColumn("b", F.size(F.filter("at", lambda a: a <= F.col("v")))).drop("at")
    sizes = placed.groupBy(*keys, "b").agg(F.sum("c").alias("bc"), F.max("n").alias("n"))
    before = F.sum("bc").over(Window.partitionBy(*keys).orderBy("b")) - F.col("bc")  # at most ``cuts`` rows a group
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(q * (F.col("n") - 1)), F.ceil(q * (F.col("n") - 1))) for q in map(F.lit, map(float, qs))])))
    wanted = sizes.withColumn("before", before).withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("bc")))).where(F.size("ranks") > 0)
    inside = placed.drop("n").join(wanted, [*keys, "b"])
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "b").orderBy("v"))
    found = inside.withColumn("upto", upto).withColumn("r", F.explode("ranks")).where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("c")))
    m = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("m"), F.max("n").alias("n"))  # two ranks a quantile
    out = []
    for q in map(float, qs):
        x = F.lit(q) * (F.col("n") - 1)
        lo, hi = F.col("m")[F.floor(x)], F.col("m")[F.ceil(x)]
        out.append(lo + (hi - lo) * (x - F.floor(x)))
    return m.select(*keys, F.array(*out).alias("q"))


def group_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], *, hot_rows: int = 2_000_000, cuts: int = 256) -> DataFrame:
    """``keys, q``: the quantiles of the non-null values of every group, as an array. No keys: one row."""
    if not keys:
        return group_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, qs, hot_rows=hot_rows, cuts=cuts).select("q")
    x = df.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    hot = x.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*keys)
    if hot.isEmpty():
        return _plain(x, keys, value, qs)
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    cold = x.alias("x").join(hot.alias("h"), on, "left_anti")
    warm = x.alias("x").join(hot.alias("h"), on, "left_semi")
    return _plain(cold, keys, value, qs).unionByName(_selected(warm, keys, value, qs, cuts))
