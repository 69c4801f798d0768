"""Gates before expensive steps, and the assembly of training samples from tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions import scalars as fn


def pixel_gate(frames: DataFrame, keys: list[str], order: str, pixels: str, *, diff: float = 0.01, mean_below: float = 0.003, share_below: float = 0.002) -> DataFrame:
    """``keys, mad, active, dropped``: mean absolute difference of consecutive gray frames and share of changed pixels.

    A window is dropped only if both are small; a window of one frame has no difference (0, 0) and is dropped.
    """
    prev = F.lag(pixels).over(Window.partitionBy(*keys).orderBy(order))
    d = F.zip_with(pixels, prev, lambda a, b: F.abs(a - b))
    f = frames.withColumn("_d", F.when(prev.isNotNull(), d))
    mean = F.aggregate("_d", F.lit(0.0), lambda a, x: a + x) / F.size("_d")
    share = F.size(F.filter("_d", lambda x: x > diff)) / F.size("_d")
    has = F.col("_d").isNotNull()
    g = f.groupBy(*keys).agg(F.coalesce(F.avg(F.when(has, mean)), F.lit(0.0)).alias("mad"), F.coalesce(F.avg(F.when(has, share)), F.lit(0.0)).alias("active"))
    return g.withColumn("dropped", (F.col("mad") < mean_below) & (F.col("active") < share_below))


def motion_gate(steps: DataFrame, keys: list[str], dr: str, dc: str, *, threshold: float, min_share: float) -> DataFrame:
    """``keys, mean_speed, active, dropped``: the same rule on point velocities."""
    v = F.sqrt(F.col(dr) * F.col(dr) + F.col(dc) * F.col(dc))
    g = steps.groupBy(*keys).agg(F.avg(v).alias("mean_speed"), F.avg(F.when(v > threshold, 1.0).otherwise(0.0)).alias("active"))
    return g.withColumn("dropped", (F.col("mean_speed") < threshold) & (F.col("active") < min_share))


def flow_magnitude(u: Column, v: Column) -> Column:
    """Mean length of a flow field given as two arrays."""
    s = F.zip_with(u, v, lambda a, b: F.sqrt(a * a + b * b))
    return F.aggregate(s, F.lit(0.0), lambda a, b: a + b) / F.size(s)


def samples(points: DataFrame, files: DataFrame, height: float, width: float) -> DataFrame:
    """Points in canonical form: missing and infinite values 0, rescaled to one frame size, normalised to [-1, 1].

    Frames of unknown size are left out: their scale cannot be told.
    """
    z = files.groupBy("file", "view_name").agg(F.max("height").alias("hh"), F.max("width").alias("ww")).where("hh > 0 and ww > 0")
    p = points.join(z, ["file", "view_name"])
    row = fn.rescale(fn.finite_or_zero(F.col("pt_row")), F.col("hh"), F.lit(height))
    col = fn.rescale(fn.finite_or_zero(F.col("pt_col")), F.col("ww"), F.lit(width))
    return p.select("point_id", "file", "view_name", "t", "h", "n", fn.normalise_coord(row, F.lit(height)).alias("u_row"), fn.normalise_coord(col, F.lit(width)).alias("u_col"), "vis")


def episode(samples_: DataFrame, file: str) -> DataFrame:
    """All starts of one episode."""
    return samples_.where(F.col("file") == file)


def by_position(a: DataFrame, b: DataFrame, order_a: str, order_b: str, n_ranges: int = 64) -> DataFrame:
    """Row i of ``a`` with row i of ``b``: positions are counted per range of the order, then offset, not by one task."""

    def numbered(df: DataFrame, order: str) -> DataFrame:
        r = df.repartitionByRange(n_ranges, order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
        from stridelake.sources.tables import materialise

        r = materialise(r.withColumn("_k", F.monotonically_increasing_id()), "ranges")
        size = r.groupBy("_p").agg(F.count("*").alias("_n"))
        before = size.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # one row a range
        within = F.row_number().over(Window.partitionBy("_p").orderBy("_k")) - 1
        return r.join(before, "_p").withColumn("position", F.col("_b") + within).drop("_p", "_k", "_b")

    return numbered(a, order_a).join(numbered(b, order_b), "position")


def merged_config(given: DataFrame, stored: DataFrame, overrides: DataFrame) -> DataFrame:
    """``key, value``: overrides first, then what is stored, then what is given; rows of key and value."""
    g, s, o = (x.select("key", F.col("value").alias(n)) for x, n in ((given, "g"), (stored, "s"), (overrides, "o")))
    return g.join(s, "key", "full").join(o, "key", "full").select("key", F.coalesce("o", "s", "g").alias("value"))


def typed(value: Column) -> Column:
    """Struct (kind, value) of an override given as text: boolean, null, number, list or string."""
    v = F.trim(value)
    low = F.lower(v)
    kind = F.when(low.isin("true", "false"), "boolean").when(low.isin("null", "none", ""), "null").when(v.try_cast("double").isNotNull(), "number").when(v.rlike(r"^\[.*\]$"), "list").otherwise("string")
    return F.struct(kind.alias("kind"), F.when(kind != "null", F.when(kind == "boolean", low).otherwise(v)).alias("value"))
