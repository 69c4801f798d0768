"""Checks of data sets: structure rules, motion reports, index maps, splits, media classification, timebase repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions.scalars import resolve_fps


def timebase_repair(docs: DataFrame, default_target: float) -> DataFrame:
    """Times scaled by target / original frame rate, with ``status`` (ok, skip_*, error_*), ``scale``, ``fixed``, ``too_long``."""
    orig = resolve_fps(F.col("fps"), F.col("segmentation_params.orig_fps"))
    target = F.when(F.col("segmentation_params.target_fps") > 0, F.col("segmentation_params.target_fps")).otherwise(default_target)
    t = docs.withColumn("orig", orig).withColumn("target", target)
    status = F.when(F.col("segments").isNull(), "error_no_segments").when(F.col("orig").isNull(), "skip_no_fps").when(F.abs(F.col("orig") - F.col("target")) < 1e-6, "skip_same_fps").otherwise("ok")
    t = t.withColumn("status", status).withColumn("scale", F.when(F.col("status") == "ok", F.col("target") / F.col("orig")))
    fixed = F.transform("segments", lambda x: F.struct((x["start_sec"] * F.col("target") / F.col("orig")).alias("start_sec"), (x["end_sec"] * F.col("target") / F.col("orig")).alias("end_sec"), x["label"].alias("label")))
    t = t.withColumn("fixed", F.when(F.col("status") == "ok", fixed))
    over = F.array_max(F.transform("fixed", lambda x: x["end_sec"])) > F.col("video_duration_sec") + 1e-6
    return t.withColumn("too_long", F.when(F.col("status") == "ok", F.coalesce(over, F.lit(False))))


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def track_checks(files: DataFrame, points: DataFrame, views: list[str], horizon: int, min_inside: float = 0.95) -> DataFrame:
    """``file, view_name, reason``: one row for every rule a (file, view) breaks."""
    p = points.groupBy("file", "view_name").agg(
        F.max("h").alias("max_h"), F.sum((F.col("pt_row").isNull() | F.col("pt_col").isNull() | F.isnan("pt_row") | F.isnan("pt_col")).cast("long")).alias("missing"), F.count("*").alias("rows")
    )
    ok = points.join(files.groupBy("file", "view_name").agg(F.max("height").alias("hh"), F.max("width").alias("ww")), ["file", "view_name"])
    inside = lambda r, c: F.avg((F.col(r).between(0, F.col("hh")) & F.col(c).between(0, F.col("ww"))).cast("double"))
    i = ok.groupBy("file", "view_name").agg(F.greatest(inside("pt_row", "pt_col"), inside("pt_col", "pt_row")).alias("inside"))
    t = files.join(p, ["file", "view_name"], "left").join(i, ["file", "view_name"], "left")
    rules = {
        "unknown_view": ~F.col("view_name").isin(views),
        "no_size": F.col("height").isNull() | F.col("width").isNull(),
        "dtype": ~F.coalesce(F.col("dtype") == "float32", F.lit(False)),
        "rank": F.coalesce(F.size("shape") != 4, F.lit(True)),
        "horizon": F.coalesce(F.get("shape", F.lit(1)) != horizon, F.lit(True)),
        "no_points": F.col("rows").isNull(),
        "missing_points": F.coalesce(F.col("missing") > 0, F.lit(False)),
        "out_of_bounds": F.coalesce(F.col("inside") < min_inside, F.lit(False)),
    }
    return t.select("file", "view_name", F.explode(reasons(rules)).alias("reason")).distinct()


def missing_views(files: DataFrame, views: list[str]) -> DataFrame:
    """Expected (file, view) pairs that are not there."""
    want = files.select("file").distinct().select("file", F.explode(F.array(*map(F.lit, views))).alias("view_name"))
    return want.join(files.select("file", "view_name"), ["file", "view_name"], "left_anti")


def examples(failures: DataFrame, reason: str, item: str, n: int = 10) -> DataFrame:
    """Counts per reason with the first ``n`` examples by name, found by rank, not by collecting all."""
    r = F.row_number().over(Window.partitionBy(reason).orderBy(item))
    top = failures.withColumn("r", r).where(F.col("r") <= n).groupBy(reason).agg(F.sort_array(F.collect_list(item)).alias("examples"))
    return failures.groupBy(reason).agg(F.count("*").alias("n")).join(top, reason)


def index_map(files: DataFrame, rollout: int) -> DataFrame:
    """One row per training sample: every start of every file whose shape is readable."""
    f = files.where((F.size("shape") == 4) & (F.get("shape", F.lit(0)) > 0))
    f = f.groupBy("file").agg(F.min(F.get("shape", F.lit(0))).cast("long").alias("len"), F.sort_array(F.collect_set("view_name")).alias("use_views"))  # views of one file
    f = f.withColumn("start_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)))
    return f.select("file", "start_t", F.least(F.col("start_t") + rollout, F.col("len")).alias("end_t"), F.lit(rollout).cast("long").alias("rollout_len"), "use_views")


def split_share(files: DataFrame, share: float, key: str = "file") -> DataFrame:
    """The first (positive) or last (negative) share of the keys in order."""
    k = files.select(key).distinct()
    n = k.count()
    take = round(abs(share) * n)
    o = F.asc(key) if share >= 0 else F.desc(key)
    return k.orderBy(o).limit(take)


def motion_report(points: DataFrame, files: DataFrame, moving: float = 0.5) -> DataFrame:
    """Per (file, view): median speed, share of steps that move, share out of bounds, share missing."""
    w = Window.partitionBy("file", "view_name", "t", "n").orderBy("h", "point_id")
    gap = F.col("h") - F.lag("h").over(w)
    v = F.sqrt(F.pow(F.col("pt_row") - F.lag("pt_row").over(w), 2) + F.pow(F.col("pt_col") - F.lag("pt_col").over(w), 2))
    s = files.groupBy("file", "view_name").agg(F.max("height").alias("hh"), F.max("width").alias("ww"))
    p = points.withColumn("speed", F.when(gap == 1, v)).join(s, ["file", "view_name"], "left")
    bad = F.col("pt_row").isNull() | F.col("pt_col").isNull()
    out = ~bad & ~(F.col("pt_row").between(0, F.col("hh")) & F.col("pt_col").between(0, F.col("ww")))
    return p.groupBy("file", "view_name").agg(
        F.percentile("speed", 0.5).alias("median_speed"), F.avg((F.col("speed") > moving).cast("double")).alias("moving_share"), F.avg(out.cast("double")).alias("out_share"), F.avg(bad.cast("double")).alias("missing_share")
    )


def recommend(report: DataFrame, horizon: DataFrame, config_horizon: int) -> DataFrame:
    """One row of findings: the usual horizon against the configuration, and shares beyond their limits."""
    a = report.agg(F.avg("moving_share").alias("moving"), F.avg("out_share").alias("out"), F.avg("missing_share").alias("missing"))
    h = horizon.agg(F.mode("horizon").alias("usual"))
    t = a.crossJoin(h)  # one row each
    rules = {"horizon_differs": F.col("usual") != config_horizon, "little_motion": F.col("moving") < 0.1, "many_out": F.col("out") > 0.05, "many_missing": F.col("missing") > 0.05}
    return t.select("usual", reasons(rules).alias("findings"))


def media_status(probe: DataFrame, keywords: list[str], max_ratio: float, max_mean: float, max_peak: float) -> DataFrame:
    """Status of each probed file: empty, corrupt, static or ok.

    ``probe``: path, size, exit_code, message, timed_out, diff_ratio, diff_mean, diff_max, early_exit. Nothing is deleted.
    """
    word = F.lower("message").rlike("|".join(keywords)) if keywords else F.lit(False)
    corrupt = F.coalesce(F.col("exit_code") != 0, F.lit(False)) | F.coalesce(word, F.lit(False)) | F.coalesce(F.col("timed_out"), F.lit(False))
    still = ~F.coalesce(F.col("early_exit"), F.lit(False)) & (F.col("diff_ratio") <= max_ratio) & (F.col("diff_mean") <= max_mean) & (F.col("diff_max") <= max_peak)
    return probe.withColumn("status", F.when(F.col("size") == 0, "empty").when(corrupt, "corrupt").when(still, "static").otherwise("ok"))


def inferred_resolution(points: DataFrame) -> DataFrame:
    """Size of every (file, view) from its largest coordinates."""
    return points.groupBy("file", "view_name").agg(F.ceil(F.max("pt_row") + 1).cast("long").alias("height"), F.ceil(F.max("pt_col") + 1).cast("long").alias("width"))
