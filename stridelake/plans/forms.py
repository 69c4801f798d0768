"""Queries on forms of trajectories, mixes of sets, rates, and the streaming job on a whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.functions import scalars as fn
from stridelake.operators import quality as Q
from stridelake.operators import series as S
from stridelake.operators import vectors as V
from stridelake.plans.common import ALL_LINES_SQL, ALL_SQL, every, r8
from stridelake.plans.energy import RULE, STREAM, recursion
from stridelake.plans.vectors import _SEG, tokens
from stridelake.sources.tables import load, shared_dir
from stridelake.streaming import segmenter as streaming

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


# --- trajectories: pixels of frames of 480 x 640 ---------------------------------------------------------------------------

_PT = "WITH p AS (SELECT point_id, pt_row, pt_col FROM tracks WHERE pt_row IS NOT NULL AND pt_col IS NOT NULL AND NOT isnan(pt_row) AND NOT isnan(pt_col)) "


def points(spark, d):
    return load(spark, d, "tracks").where("pt_row is not null and pt_col is not null and not isnan(pt_row) and not isnan(pt_col)").select("point_id", "pt_row", "pt_col")


@query("f20_rounded", _PT + "SELECT point_id, round_even((pt_row / 64.0::DOUBLE - 1) * 128 / 2, 0) * 2 / 128 + 0.0 AS u, round_even((pt_col / 64.0::DOUBLE - 1) * 128 / 2, 0) * 2 / 128 + 0.0 AS v FROM p")
def f20_rounded(spark, d):
    at = lambda c: (fn.round_to_pixels(F.col(c) / 64.0 - 1, F.lit(128.0)) + 0.0)
    return points(spark, d).select("point_id", at("pt_row").alias("u"), at("pt_col").alias("v"))


@query(
    "f20_center_crop",
    _PT + "SELECT point_id, round((pt_row - 120 - 120) / 120.0::DOUBLE, 8) + 0.0 AS u, round((pt_col - 160 - 160) / 160.0::DOUBLE, 8) + 0.0 AS v FROM p WHERE pt_row - 120 >= 0 AND pt_row - 120 < 240 AND pt_col - 160 >= 0 AND pt_col - 160 < 320",
)
def f20_crop(spark, d):
    x = points(spark, d).select("point_id", fn.center_crop(F.col("pt_row"), 480, 240).alias("u"), fn.center_crop(F.col("pt_col"), 640, 320).alias("v"))
    return x.where("u is not null and v is not null").select("point_id", r8(F.col("u")).alias("u"), r8(F.col("v")).alias("v"))


@query("f20_resized", _PT + "SELECT point_id, round_even(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (pt_row - 240.0::DOUBLE) / 240.0::DOUBLE)) * 128.0::DOUBLE + 128.0::DOUBLE, 0) AS px FROM p")
def f20_resized(spark, d):
    return points(spark, d).select("point_id", fn.resize_coord(F.col("pt_row"), 480, 256).alias("px"))


@query(
    "f20_resize_crop",
    _PT + "SELECT point_id, round(((pt_row / 240.0::DOUBLE - 1) + 40 / 480.0::DOUBLE * 2) * 1.5, 8) + 0.0 AS u, round(((pt_col / 320.0::DOUBLE - 1) + 20 / 640.0::DOUBLE * 2) * (640 / 480.0::DOUBLE), 8) + 0.0 AS v FROM p",
)
def f20_resize_crop(spark, d):
    """The part of 320 x 480 pixels from (40, 60), stretched to the whole frame."""
    u = fn.resize_crop(F.col("pt_row") / 240.0 - 1, 40.0, 320.0, 480.0)
    v = fn.resize_crop(F.col("pt_col") / 320.0 - 1, 60.0, 480.0, 640.0)
    return points(spark, d).select("point_id", r8(u).alias("u"), r8(v).alias("v"))


@query(
    "f22_query_formats",
    _PT + "SELECT point_id, round(pt_col / 640.0::DOUBLE, 8) + 0.0 AS atm_x, round(pt_row / 480.0::DOUBLE, 8) + 0.0 AS atm_y, CAST(0 AS INT) AS t, round(pt_col / 640.0::DOUBLE * 256, 8) + 0.0 AS track_x, round(pt_row / 480.0::DOUBLE * 256, 8) + 0.0 AS track_y FROM p",
)
def f22(spark, d):
    """Standard queries (row, col in [-1, 1]) as columns before rows in [0, 1], and in pixels with a time."""
    x, y = (fn.query_standard_to_unit(F.col(c) / s - 1) for c, s in (("pt_col", 320.0), ("pt_row", 240.0)))
    px = lambda c: r8(fn.query_unit_to_pixels(c, F.lit(256.0)))
    return points(spark, d).select("point_id", r8(x).alias("atm_x"), r8(y).alias("atm_y"), F.lit(0).alias("t"), px(x).alias("track_x"), px(y).alias("track_y"))


@query(
    "f25_levels",
    """SELECT p_partkey, CASE 4 + p_size % 9 WHEN 4 THEN '5,3' WHEN 6 THEN '8,8' WHEN 8 THEN '8,6,5' WHEN 9 THEN '8,8,8' WHEN 10 THEN '8,5,5,5' WHEN 11 THEN '8,8,6,5' WHEN 12 THEN '7,5,5,5,5' END AS levels FROM part WHERE p_size IS NOT NULL""",
)
def f25(spark, d):
    """Levels of code books whose size is a power of two; null for sizes without an entry."""
    size = F.pow(F.lit(2.0), 4 + F.col("p_size") % 9)
    levels = fn.levels_of(size)
    return load(spark, d, "part").where("p_size is not null").select("p_partkey", F.when(levels.isNotNull(), F.concat_ws(",", levels.cast("array<string>"))).alias("levels"))


@query(
    "c23_unit_norm_pool",
    _SEG + """, t AS (SELECT seg, sum(nrm + 1e-9) AS t FROM nm GROUP BY seg), z AS (SELECT e.seg, dim, sum(a / t) AS z FROM e JOIN t USING (seg) GROUP BY e.seg, dim), l AS (SELECT seg, sqrt(sum(z * z)) AS l FROM z GROUP BY seg)
    SELECT z.seg, dim, round(z / (l + 1e-9), 8) + 0.0 AS v FROM z JOIN l USING (seg)""",
)
def c23(spark, d):
    """Frames aggregated as unit vectors by their share of the length."""
    return tokens(spark, d).select("seg", F.posexplode(V.pool_unit_norm(F.col("tokens"))).alias("dim", "v")).select("seg", F.col("dim").cast("long").alias("dim"), r8(F.col("v")).alias("v"))


# --- rates, mixes -------------------------------------------------------------------------------------------------------------


@query(
    "w21_rate_ema",
    """WITH RECURSIVE l0 AS (SELECT path, line_id, (epoch_us(written_at) - epoch_us(lag(written_at) OVER (PARTITION BY path ORDER BY line_id))) / 1e6 AS energy FROM energy WHERE path IS NOT NULL AND written_at IS NOT NULL),
    s AS (SELECT path, line_id AS win, energy, row_number() OVER (PARTITION BY path ORDER BY line_id) - 1 AS i FROM l0 WHERE energy IS NOT NULL),"""
    + recursion(0.1, RULE)
    + "SELECT st.path, s.win AS line_id, round(st.y, 6) AS ema FROM st JOIN s ON st.path = s.path AND st.i = s.i",
)
def w21(spark, d):
    """Smoothed seconds between the lines of a file, the first one seeding."""
    from pyspark.sql import Window

    us = F.unix_micros("written_at")
    e = load(spark, d, "energy").where("path is not null and written_at is not null")
    sec = e.select("path", F.col("line_id").alias("win"), ((us - F.lag(us).over(Window.partitionBy("path").orderBy("line_id"))) / 1e6).alias("energy")).where("energy is not null")
    return S.ema(sec, 0.1).select("path", F.col("win").alias("line_id"), (F.round("ema", 6) + 0.0).alias("ema"))


def mix(sets: dict[str, tuple[DataFrame, float]], key: str) -> DataFrame:
    """``modality, key``: of every set its first (or, with a negative share, last) share, together."""
    return reduce(DataFrame.unionByName, [Q.split_share(df, share, key).select(F.lit(name).alias("modality"), key) for name, (df, share) in sets.items()])


_MIX = {"quantized": 0.8, "velocity": 0.4, "prequant": -0.2}


@query(
    "q04_mix",
    ALL_SQL
    + """, f AS (SELECT DISTINCT source, stem FROM s WHERE source IN ('quantized', 'velocity', 'prequant') AND stem IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY stem) AS k, row_number() OVER (PARTITION BY source ORDER BY stem DESC) AS z, count(*) OVER (PARTITION BY source) AS n FROM f)
    SELECT source AS modality, stem FROM r WHERE CASE source WHEN 'quantized' THEN k <= round_even(0.8 * n, 0) WHEN 'velocity' THEN k <= round_even(0.4 * n, 0) ELSE z <= round_even(0.2 * n, 0) END""",
)
def q04(spark, d):
    """A mix of modalities by share; shares are honoured, so a positive and the negative rest never overlap."""
    s = every(spark, d).where("stem is not null")
    return mix({name: (s.where(F.col("source") == name), share) for name, share in _MIX.items()}, "stem")


# --- the streaming job ------------------------------------------------------------------------------------------------------------


@query(
    "t03_streaming_job",
    "WITH RECURSIVE "
    + ALL_LINES_SQL
    + ", s2 AS (SELECT path, win, energy, row_number() OVER (PARTITION BY path ORDER BY win) - 1 AS i FROM s WHERE win >= 0),"
    + recursion(None, STREAM, "s2")
    + """SELECT c.path, a.win AS i0, b.win AS i1, c.len AS windows FROM (SELECT path, start, i, len FROM st WHERE closed AND len >= 3) c
    JOIN s2 a ON a.path = c.path AND a.i = c.start JOIN s2 b ON b.path = c.path AND b.i = c.i""",
)
def t03_job(spark, d):
    """The table replayed through a stream in several micro-batches with kept state; closed segments only."""
    root = shared_dir(spark)
    rows = every(spark, d).where("win >= 0").select("path", "win", "energy", F.col("win").alias("line_id"))
    low, high = rows.approxQuantile("win", [1 / 3, 2 / 3], 0.01) or (0, 0)
    for part in (F.col("win") <= low, (F.col("win") > low) & (F.col("win") <= high), F.col("win") > high):
        rows.where(part).repartition(4, "path").write.mode("append").parquet(f"{root}/lines")
    out = streaming.segments(streaming.read_energy(spark, f"{root}/lines", 4), STREAM, min_windows=3)
    streaming.run_once(out, f"{root}/state", f"{root}/segments")
    return spark.read.schema(streaming.OUT).json(f"{root}/segments")
