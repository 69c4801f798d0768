"""Queries on energy streams: scans, alignment, smoothing, statistics, labels and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.functions import scalars as fn
from stridelake.operators import evaluate as E
from stridelake.operators import segmenter as G
from stridelake.operators import series as S
from stridelake.plans.common import ALL_LINES_SQL, ALL_SQL, DT, FPS, LINES_SQL, SERIES_SQL, STRIDE, every, every_line, r8, series
from stridelake.sources.tables import load

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- scans ---------------------------------------------------------------------------------------------------------


@query("s01_lines_in_order", ALL_SQL + "SELECT path, win, energy, row_number() OVER (PARTITION BY path ORDER BY win, line_id) AS n FROM lines")
def s01(spark, d):
    from pyspark.sql import Window

    return every_line(spark, d).select("path", "win", "energy", F.row_number().over(Window.partitionBy("path").orderBy("win", "line_id")).cast("long").alias("n"))


@query("s02_last_per_window", ALL_SQL + "SELECT path, win, energy FROM lastw")
def s02(spark, d):
    return every(spark, d).select("path", "win", "energy")


@query("s02_first_per_window", ALL_SQL + "SELECT path, win, min_by(energy, line_id) AS energy FROM lines GROUP BY path, win")
def s02_first(spark, d):
    return S.keep_per_window(every_line(spark, d), "first").select("path", "win", "energy")


@query("s03_drop_missing", "SELECT line_id, path, win_idx AS win, energy FROM energy WHERE win_idx IS NOT NULL AND energy IS NOT NULL AND NOT isnan(energy)")
def s03(spark, d):
    return load(spark, d, "energy").where("win_idx is not null and energy is not null and not isnan(energy)").select("line_id", "path", F.col("win_idx").alias("win"), "energy")


@query(
    "s04_source_mode",
    r"""SELECT path, coalesce(arg_min(source, line_id), nullif(regexp_extract(path, 'stream_energy_(optical_flow|[^_/]+)_([^/]+)\.jsonl$', 1), '')) AS source,
    coalesce(arg_min(mode, line_id), nullif(regexp_extract(path, 'stream_energy_(optical_flow|[^_/]+)_([^/]+)\.jsonl$', 2), '')) AS mode FROM energy WHERE path IS NOT NULL GROUP BY path""",
)
def s04(spark, d):
    return S.resolve_source(load(spark, d, "energy"))


@query(
    "s05_file_by_priority",
    r"""WITH f AS (SELECT DISTINCT path, regexp_extract(path, '^(.*)/[^/]+$', 1) AS folder FROM energy WHERE path IS NOT NULL)
    SELECT folder, path FROM f QUALIFY row_number() OVER (PARTITION BY folder ORDER BY CASE WHEN path LIKE '%/stream_energy_velocity_token_diff_l2_mean.jsonl' THEN 0 WHEN path LIKE '%energy_split1%' THEN 1 ELSE 2 END, path) = 1""",
)
def s05(spark, d):
    from stridelake.sources.readers import by_priority

    f = load(spark, d, "energy").where("path is not null").select("path").distinct()
    return by_priority(f, ["/stream_energy_velocity_token_diff_l2_mean.jsonl", "energy_split1"])


# --- smoothing and resampling ------------------------------------------------------------------------------------------


def recursion(alpha: float | None, rule: G.Rule, base: str = "s") -> str:
    """SQL that steps all series at once: ``st`` holds the state after every place; ``seg`` the closed segments."""
    y = f"CASE WHEN n.i = 0 THEN n.energy ELSE {alpha} * n.energy + (1 - {alpha}) * p.y END" if alpha is not None else "n.energy"
    up, down = max(1, rule.up), max(1, rule.down)
    if rule.mode == "batch":
        on, cap = "was", f"({rule.max_windows} > 0 AND l1 >= {rule.max_windows})"
        rest = f"""SELECT *, was AND (n1 >= {down} OR {cap}) AS closed FROM (SELECT *, CASE WHEN y < {rule.off!r} THEN neg + 1 ELSE 0 END AS n1, len + 1 AS l1 FROM b) z"""
        new = f"""(was AND NOT closed) OR act AS active, CASE WHEN act OR closed THEN 0 WHEN was THEN pos ELSE p1 END AS pos, CASE WHEN was AND NOT closed THEN n1 ELSE 0 END AS neg,
          CASE WHEN closed THEN {rule.cooldown} ELSE c1 END AS cool, CASE WHEN act THEN i ELSE start END AS start, CASE WHEN was AND NOT closed THEN l1 ELSE 0 END AS len"""
    else:
        on, cap = "(was OR act)", f"({rule.max_windows} > 0 AND l1 >= {rule.max_windows})"
        rest = f"""SELECT *, {on} AND ({cap} OR n1 >= {down}) AS closed FROM (SELECT *, CASE WHEN {cap} THEN CASE WHEN act THEN 0 ELSE neg END WHEN y < {rule.off!r} THEN CASE WHEN act THEN 0 ELSE neg END + 1 ELSE 0 END AS n1
          FROM (SELECT *, CASE WHEN act THEN 0 ELSE len END + 1 AS l1 FROM b) y) z"""
        new = f"""{on} AND NOT closed AS active, CASE WHEN act THEN 0 WHEN was THEN pos ELSE p1 END AS pos, CASE WHEN {on} THEN n1 ELSE neg END AS neg,
          CASE WHEN closed THEN greatest(c1, {rule.cooldown}) ELSE c1 END AS cool, CASE WHEN act THEN i ELSE start END AS start, CASE WHEN {on} THEN l1 ELSE len END AS len"""
    return f"""
st AS (SELECT DISTINCT path, CAST(-1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS y, false AS active, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS neg, CAST(0 AS BIGINT) AS cool,
         CAST(-1 AS BIGINT) AS start, CAST(0 AS BIGINT) AS len, false AS closed FROM {base}
  UNION ALL
  SELECT path, i, y, {new}, closed FROM (
    WITH a AS (SELECT n.path, n.i, {y} AS y, p.active AS was, p.pos, p.neg, p.start, p.len, greatest(p.cool - 1, 0) AS c1 FROM st p JOIN {base} n ON n.path = p.path AND n.i = p.i + 1),
    a2 AS (SELECT *, CASE WHEN was THEN pos WHEN y >= {rule.on!r} THEN pos + 1 ELSE 0 END AS p1 FROM a),
    b AS (SELECT *, NOT was AND c1 = 0 AND p1 >= {up} AS act FROM a2)
    {rest}) q),
lastst AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY path ORDER BY i DESC) = 1),
seg AS (SELECT path, start AS i0, i AS i1, len AS windows FROM st WHERE closed UNION ALL SELECT path, start, i, len FROM lastst WHERE active)
"""


RULE = G.Rule(on=1.0, ratio=0.9, up=2, down=2, cooldown=1, max_windows=40)
STREAM = G.Rule(on=1.0, ratio=0.9, up=2, down=2, cooldown=1, max_windows=40, mode="stream")
ALPHA = 0.7


@query("w04_ema", "WITH RECURSIVE " + LINES_SQL + "," + recursion(ALPHA, RULE) + "SELECT st.path, s.win, round(st.y, 8) AS ema FROM st JOIN s ON st.path = s.path AND st.i = s.i")
def w04(spark, d):
    return S.ema(series(spark, d), ALPHA).select("path", "win", r8(F.col("ema")).alias("ema"))


@query("w05_moving_average", SERIES_SQL + "SELECT path, win, round(avg(energy) OVER (PARTITION BY path ORDER BY win ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 8) AS ma FROM s")
def w05(spark, d):
    return S.moving_average(series(spark, d), 5).select("path", "win", r8(F.col("ma")).alias("ma"))


@query("w06_stride_mean", SERIES_SQL + "SELECT path, i // 4 AS g, round(avg(energy), 8) AS energy FROM s GROUP BY path, i // 4")
def w06(spark, d):
    return S.stride_mean(series(spark, d), 4).withColumn("energy", r8(F.col("energy")))


@query("w07_every_nth", ALL_SQL + "SELECT path, win, energy FROM s WHERE i % 3 = 0")
def w07(spark, d):
    return S.every_nth(every(spark, d), 30.0, 10.0).select("path", "win", "energy")


@query(
    "w07_time_ticks",
    ALL_SQL + "SELECT path, win, energy FROM (SELECT *, floor(i * 4.0 / 10.0 + 1e-6) AS t FROM s) QUALIFY coalesce(t > lag(t) OVER (PARTITION BY path ORDER BY win), true)",
)
def w07_ticks(spark, d):
    return S.resample_ticks(every(spark, d), 10.0, 4.0).select("path", "win", "energy")


@query("w08_differences", SERIES_SQL + "SELECT path, win, round(energy - lag(energy) OVER (PARTITION BY path ORDER BY win), 8) + 0.0 AS diff FROM s")
def w08(spark, d):
    return S.differences(series(spark, d)).select("path", "win", r8(F.col("diff")).alias("diff"))


@query("w09_rebuilt", SERIES_SQL + "SELECT path, win, round(energy, 8) AS value FROM s")
def w09(spark, d):
    from pyspark.sql import Window

    x = S.differences(series(spark, d)).withColumn("start", F.first("energy").over(Window.partitionBy("path").orderBy("win")))
    return S.cumulative(x).select("path", "win", r8(F.col("value")).alias("value"))


@query(
    "w11_runs",
    ALL_SQL + "SELECT path, min(win) AS start_win, max(win) AS end_win, count(*) AS n FROM (SELECT *, win - row_number() OVER (PARTITION BY path ORDER BY win) AS g FROM s) GROUP BY path, g",
)
def w11(spark, d):
    return S.runs(every(spark, d))


@query(
    "w12_longest_run",
    ALL_SQL + """, r AS (SELECT path, min(win) AS start_win, max(win) AS end_win, count(*) AS n FROM (SELECT *, win - row_number() OVER (PARTITION BY path ORDER BY win) AS g FROM s) GROUP BY path, g)
    SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC, start_win) = 1""",
)
def w12(spark, d):
    return S.longest_run(every(spark, d))


@query("w12_seeded_run")
def w12_seeded(spark, d):
    return S.pick_run(every(spark, d), 50)


@query("w14_crop_starts", "SELECT doc_path, unnest(range(0, CAST(floor((video_duration_sec - 30) / 10) AS BIGINT) + 1)) * 10.0::DOUBLE AS start_sec FROM seg_docs WHERE video_duration_sec >= 30")
def w14(spark, d):
    return load(spark, d, "seg_docs").where("video_duration_sec is not null").select("doc_path", F.explode(fn.crop_starts(F.col("video_duration_sec"), 30.0, 10.0)).alias("start_sec"))


@query(
    "w16_interpolate",
    SERIES_SQL + """, n AS (SELECT path, count(*) AS n FROM s GROUP BY path), t AS (SELECT path, n, unnest(range(0, 16)) AS j FROM n),
    x AS (SELECT path, n, j, j * (n - 1) / 15.0::DOUBLE AS x FROM t), y AS (SELECT *, CAST(floor(x) AS BIGINT) AS lo, least(CAST(ceil(x) AS BIGINT), n - 1) AS hi FROM x)
    SELECT y.path, y.j, round(a.energy + (b.energy - a.energy) * (y.x - y.lo), 8) AS value FROM y JOIN s a ON a.path = y.path AND a.i = y.lo JOIN s b ON b.path = y.path AND b.i = y.hi""",
)
def w16(spark, d):
    return S.interpolate(series(spark, d), 16).withColumn("value", r8(F.col("value")))


@query("w17_spline")
def w17(spark, d):
    return S.spline(series(spark, d), 16)


@query(
    "w18_paa",
    SERIES_SQL + """, z AS (SELECT *, count(*) OVER (PARTITION BY path) AS size FROM s)
    SELECT path, CASE WHEN size <= 32 THEN i ELSE i * 32 // size END AS bucket, round(avg(energy), 8) AS energy FROM z GROUP BY path, CASE WHEN size <= 32 THEN i ELSE i * 32 // size END""",
)
def w18(spark, d):
    return S.paa(series(spark, d), 32).withColumn("energy", r8(F.col("energy")))


@query(
    "w20_axis_fps",
    SERIES_SQL + """, d AS (SELECT regexp_replace(video, '\\.mp4$', '') AS stem, max(video_duration_sec) AS dur FROM seg_docs WHERE video_duration_sec IS NOT NULL AND video IS NOT NULL GROUP BY 1)
    SELECT path, round(CASE WHEN abs(m * 4.0 / 10.0 - dur) > 5 AND dur > 0 THEN m / dur * 4.0 ELSE 10.0 END, 8) AS fps FROM (SELECT path, min(stem) AS stem, max(win) AS m FROM s GROUP BY path) JOIN d USING (stem)""",
)
def w20(spark, d):
    dur = load(spark, d, "seg_docs").where("video is not null").groupBy(F.regexp_replace("video", r"\.mp4$", "").alias("stem")).agg(F.max("video_duration_sec").alias("duration_sec")).where("duration_sec is not null")
    s = series(spark, d)
    stems = s.groupBy("path").agg(F.min("stem").alias("stem")).join(dur, "stem").select("path", "duration_sec")
    return S.axis_fps(s, stems, STRIDE, FPS).withColumn("fps", r8(F.col("fps")))


# --- alignment -----------------------------------------------------------------------------------------------------------

_PAIR = SERIES_SQL + """, a AS (SELECT stem, win, energy FROM s WHERE source = 'quantized'), b AS (SELECT stem, win, energy FROM s WHERE source = 'velocity'),
ab AS (SELECT a.stem, a.win, a.energy AS a, b.energy AS b FROM a JOIN b ON a.stem = b.stem AND a.win = b.win)
"""


def pair(spark, d):
    """Energies of the quantized and the velocity stream of a stem at common windows."""
    s = series(spark, d)
    return S.align(s.where("source = 'quantized'"), s.where("source = 'velocity'"), ["stem", "win"])


@query("j01_align", _PAIR + "SELECT stem, win, a, b FROM ab")
def j01(spark, d):
    return pair(spark, d)


@query(
    "j02_align_all",
    ALL_SQL + """, m AS (SELECT stem, count(DISTINCT source) AS k FROM s GROUP BY stem), c AS (SELECT stem, win FROM s JOIN m USING (stem) GROUP BY stem, win, k HAVING count(DISTINCT source) = k),
    h AS (SELECT DISTINCT stem FROM c) SELECT s.stem, s.source, s.win, s.energy FROM s WHERE s.stem IS NOT NULL AND (EXISTS (SELECT 1 FROM c WHERE c.stem = s.stem AND c.win = s.win) OR s.stem NOT IN (SELECT stem FROM h))""",
)
def j02(spark, d):
    return S.align_all(every(spark, d).where("stem is not null"), "stem", "source").select("stem", "source", "win", "energy")


@query("j03_common_stems", ALL_SQL + "SELECT DISTINCT stem FROM s WHERE stem IN (SELECT regexp_replace(video, '\\.mp4$', '') FROM seg_docs WHERE doc_kind = 'gt')")
def j03(spark, d):
    gt = load(spark, d, "seg_docs").where("doc_kind = 'gt'").select(F.regexp_replace("video", r"\.mp4$", "").alias("stem"))
    return every(spark, d).select("stem").join(gt, "stem", "left_semi").distinct()


# --- statistics ---------------------------------------------------------------------------------------------------------

_STATS = "count(*) AS n, round(avg(energy), 8) AS mean, round(stddev_pop(energy), 8) AS std, min(energy) AS min, max(energy) AS max"
_Q = ", ".join(f"round(quantile_cont(energy, {q}), 8) AS {c}" for q, c in zip(S.QUANTILES, ("q10", "q25", "q50", "q75", "q90")))


@query("a01_describe", SERIES_SQL + f"SELECT path, {_STATS}, {_Q} FROM s GROUP BY path")
def a01(spark, d):
    x = S.describe(series(spark, d), ["path"])
    return x.select("path", "n", *[r8(F.col(c)).alias(c) for c in ("mean", "std")], "min", "max", *[r8(F.col(c)).alias(c) for c in ("q10", "q25", "q50", "q75", "q90")])


@query("a02_describe_source", SERIES_SQL + "SELECT source, min(energy) AS min, max(energy) AS max, round(quantile_cont(energy, 0.25), 8) AS q25, round(quantile_cont(energy, 0.5), 8) AS q50, round(quantile_cont(energy, 0.75), 8) AS q75, round(quantile_cont(energy, 0.9), 8) AS q90 FROM s GROUP BY source")
def a02(spark, d):
    x = S.describe(series(spark, d), ["source"])
    return x.select("source", "min", "max", *[r8(F.col(c)).alias(c) for c in ("q25", "q50", "q75", "q90")])


@query(
    "a10_latency",
    """WITH w AS (SELECT path, epoch_us(written_at) - epoch_us(lag(written_at) OVER (PARTITION BY path ORDER BY line_id)) AS us FROM energy WHERE path IS NOT NULL AND written_at IS NOT NULL),
    l AS (SELECT path, us / 1e6 AS sec FROM w WHERE us IS NOT NULL)
    SELECT path, round(avg(sec), 8) AS mean, round(quantile_cont(sec, 0.5), 8) AS p50, round(quantile_cont(sec, 0.95), 8) AS p95, round(max(sec), 8) AS max, round(avg(CASE WHEN sec <= 0.4 THEN 1.0 ELSE 0.0 END), 8) AS ok_ratio FROM l GROUP BY path""",
)
def a10(spark, d):
    """Delay between lines of a file, and the share within the budget of a window."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("line_id")
    us = F.unix_micros("written_at")
    e = load(spark, d, "energy").where("path is not null and written_at is not null").select("path", ((us - F.lag(us).over(w)) / 1e6).alias("sec")).where("sec is not null")
    q = F.percentile("sec", [0.5, 0.95])
    g = e.groupBy("path").agg(F.avg("sec").alias("mean"), q.alias("q"), F.max("sec").alias("max"), F.avg(F.when(F.col("sec") <= DT, 1.0).otherwise(0.0)).alias("ok_ratio"))
    return g.select("path", r8(F.col("mean")).alias("mean"), r8(F.col("q")[0]).alias("p50"), r8(F.col("q")[1]).alias("p95"), r8(F.col("max")).alias("max"), r8(F.col("ok_ratio")).alias("ok_ratio"))


@query(
    "a19_otsu",
    SERIES_SQL + """, f AS (SELECT path, energy FROM s), r AS (SELECT path, min(energy) AS lo, max(energy) AS hi FROM f GROUP BY path),
    b AS (SELECT path, lo, hi, CASE WHEN hi > lo THEN least(255, CAST(floor((energy - lo) / (hi - lo) * 256) AS BIGINT)) ELSE 0 END AS bin FROM f JOIN r USING (path)),
    h AS (SELECT path, bin, count(*) AS c FROM b GROUP BY path, bin), g AS (SELECT path, lo, hi, unnest(range(0, 256)) AS bin FROM r),
    x AS (SELECT g.path, lo, hi, g.bin, coalesce(c, 0) AS c, lo + (g.bin + 0.5) * (hi - lo) / 256 AS centre FROM g LEFT JOIN h ON h.path = g.path AND h.bin = g.bin),
    y AS (SELECT *, sum(c) OVER o AS w0, sum(c * centre) OVER o AS s0, sum(c) OVER e AS w, sum(c * centre) OVER e AS s FROM x WINDOW o AS (PARTITION BY path ORDER BY bin), e AS (PARTITION BY path)),
    v AS (SELECT *, coalesce(CASE WHEN w0 > 0 AND w > w0 THEN w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) END, 0) AS var FROM y)
    SELECT path, round(CASE WHEN hi = lo THEN lo ELSE centre END, 8) AS threshold FROM v WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY round(var, 8) DESC, bin) = 1""",
)
def a19(spark, d):
    """Of all values of the series, with bins over [min, max]."""
    return S.otsu(series(spark, d), ["path"]).withColumn("threshold", r8(F.col("threshold")))


@query("a20_histogram", SERIES_SQL + "SELECT source, least(499, CAST(floor(energy / 1.0 * 500) AS BIGINT)) AS bin, count(*) AS n FROM s WHERE energy BETWEEN 0 AND 1 GROUP BY 1, 2")
def a20(spark, d):
    return S.histogram(series(spark, d), ["source"], F.col("energy"), 0.0, 1.0, 500)


@query("a23_interval_means", SERIES_SQL + "SELECT path, win // 50 AS step, round(avg(energy), 8) AS mean FROM s GROUP BY path, win // 50")
def a23(spark, d):
    return series(spark, d).groupBy("path", F.floor(F.col("win") / 50).cast("long").alias("step")).agg(r8(F.avg("energy")).alias("mean"))


@query(
    "a24_mean_of_means",
    SERIES_SQL + """, f AS (SELECT source, path, avg(CASE WHEN energy > 1 THEN 1.0 ELSE 0.0 END) AS m FROM s GROUP BY source, path), g AS (SELECT source, avg(m) AS m FROM f GROUP BY source)
    SELECT source, round(m, 8) AS rate FROM g UNION ALL SELECT 'overall', round(avg(m), 8) FROM g""",
)
def a24(spark, d):
    f = series(spark, d).groupBy("source", "path").agg(F.avg(F.when(F.col("energy") > 1, 1.0).otherwise(0.0)).alias("m"))
    g = f.groupBy("source").agg(F.avg("m").alias("m"))
    return g.select("source", r8(F.col("m")).alias("rate")).unionByName(g.agg(r8(F.avg("m")).alias("rate")).select(F.lit("overall").alias("source"), "rate"))


# --- labels, thresholds, separability ---------------------------------------------------------------------------------------

_LAB = _PAIR + """, q AS (SELECT stem, quantile_cont(b, 0.75) AS t FROM ab GROUP BY stem), lab AS (SELECT ab.stem, win, a AS x, b > t AS y FROM ab JOIN q USING (stem))
"""


def labelled(spark, d):
    """Labels from the reference stream: above its 75 % quantile."""
    ab = pair(spark, d)
    q = ab.groupBy("stem").agg(F.percentile("b", 0.75).alias("t"))
    return ab.join(q, "stem").select("stem", "win", F.col("a").alias("x"), (F.col("b") > F.col("t")).alias("y"))


@query("e06_labels", _LAB + "SELECT stem, win, y FROM lab")
def e06(spark, d):
    return labelled(spark, d).select("stem", "win", "y")


_RATES = """SELECT *, tp / (tp + fn + 1e-12) AS tpr, fp / (fp + tn + 1e-12) AS fpr, tp / (tp + fp + 1e-12) AS precision, (tp + tn) / (tp + tn + fp + fn + 1e-12) AS acc FROM """
_CONF = "sum(CASE WHEN {p} AND y THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN NOT {p} AND NOT y THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN {p} AND NOT y THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT {p} AND y THEN 1 ELSE 0 END) AS fn"


@query(
    "a03_confusion",
    _LAB + f", c AS (SELECT stem, {_CONF.format(p='(x > 1.0)')} FROM lab GROUP BY stem), r AS ({_RATES} c) SELECT stem, CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tpr, 8) AS tpr, round(fpr, 8) AS fpr, round(precision, 8) AS precision, round(acc, 8) AS acc, round(2 * precision * tpr / (precision + tpr + 1e-12), 8) AS f1 FROM r",
)
def a03(spark, d):
    c = E.confusion(labelled(spark, d), ["stem"], "x", "y", F.lit(1.0))
    return c.select("stem", "tp", "tn", "fp", "fn", *[r8(F.col(x)).alias(x) for x in ("tpr", "fpr", "precision", "acc", "f1")])


_SWEEP = _LAB + f""", v AS (SELECT DISTINCT stem, x AS thr FROM lab), c AS (SELECT v.stem, v.thr, {_CONF.format(p='(l.x > v.thr)')} FROM v JOIN lab l ON l.stem = v.stem GROUP BY v.stem, v.thr),
r AS ({_RATES} c), w AS (SELECT *, round(tpr - fpr, 9) AS j, round(2 * precision * tpr / (precision + tpr + 1e-12), 9) AS f FROM r)
"""


@query(
    "o02_best_threshold",
    _SWEEP + """SELECT a.stem, a.thr AS thr_j, round(a.j, 8) AS best_j, b.thr AS thr_f1, round(b.f, 8) AS best_f1 FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY stem ORDER BY j DESC, thr) = 1) a
    JOIN (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY stem ORDER BY f DESC, thr) = 1) b ON a.stem = b.stem""",
)
def o02(spark, d):
    """Threshold search against a proxy."""
    b = E.best_threshold(E.threshold_sweep(labelled(spark, d), "stem", "x", "y"), "stem")
    return b.select("stem", "thr_j", r8(F.col("best_j")).alias("best_j"), "thr_f1", r8(F.col("best_f1")).alias("best_f1"))


@query(
    "v06_view_threshold",
    _SWEEP + """, best AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY stem ORDER BY f DESC, thr) = 1)
    SELECT split_part(stem, '_', 2) AS view_name, round(quantile_cont(thr, 0.5), 8) AS median_thr, round(avg(thr), 8) AS mean_thr, count(*) AS n FROM best GROUP BY 1""",
)
def v06(spark, d):
    """One threshold per view from those of its videos."""
    b = E.best_threshold(E.threshold_sweep(labelled(spark, d), "stem", "x", "y"), "stem")
    return b.groupBy(F.split_part("stem", F.lit("_"), F.lit(2)).alias("view_name")).agg(r8(F.percentile("thr_f1", 0.5)).alias("median_thr"), r8(F.avg("thr_f1")).alias("mean_thr"), F.count("*").alias("n"))


@query(
    "u02_candidates",
    SERIES_SQL + """, q AS (SELECT path, unnest(quantile_cont(energy, [0.5, 0.6, 0.7, 0.8, 0.9])) AS v FROM s GROUP BY path), u AS (SELECT DISTINCT path, v FROM q),
    m AS (SELECT path, (v + lead(v) OVER (PARTITION BY path ORDER BY v)) / 2 AS v FROM u)
    SELECT DISTINCT path, round(v, 8) AS thr FROM (SELECT path, v FROM u UNION ALL SELECT path, v FROM m WHERE v IS NOT NULL UNION ALL SELECT path, min(energy) FROM s GROUP BY path UNION ALL SELECT path, max(energy) FROM s GROUP BY path)""",
)
def u02(spark, d):
    return E.candidates(series(spark, d)).select("path", r8(F.col("thr")).alias("thr")).distinct()


@query(
    "e07_auc",
    _LAB + """, r AS (SELECT *, rank() OVER (PARTITION BY stem ORDER BY x) + (count(*) OVER (PARTITION BY stem, x) - 1) / 2.0 AS rk FROM lab),
    au AS (SELECT stem, sum(CASE WHEN y THEN rk END) AS sm, sum(CASE WHEN y THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y THEN 0 ELSE 1 END) AS q FROM r GROUP BY stem)
    SELECT stem, CASE WHEN p * q > 0 THEN round((sm - p * (p + 1) / 2.0) / (p * q), 8) END AS auc FROM au""",
)
def e07_auc(spark, d):
    return E.roc_auc(labelled(spark, d), "stem", "x", "y").withColumn("auc", r8(F.col("auc")))


@query(
    "e07_cohens_d",
    _LAB + """, co AS (SELECT stem, avg(x) FILTER (y) AS m1, avg(x) FILTER (NOT y) AS m0, var_samp(x) FILTER (y) AS v1, var_samp(x) FILTER (NOT y) AS v0, count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n0 FROM lab GROUP BY stem)
    SELECT stem, round((m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / nullif(n1 + n0 - 2, 0)), 0), 5) AS d FROM co""",
)
def e07_d(spark, d):
    return E.cohens_d(labelled(spark, d), "stem", "x", "y").withColumn("d", F.round("d", 5) + 0.0)


@query(
    "e07_ks",
    _LAB + """, v AS (SELECT stem, x, sum(CASE WHEN y THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y THEN 0 ELSE 1 END) AS q FROM lab GROUP BY stem, x),
    c AS (SELECT stem, sum(p) OVER o AS cp, sum(q) OVER o AS cq, sum(p) OVER e AS tp, sum(q) OVER e AS tq FROM v WINDOW o AS (PARTITION BY stem ORDER BY x), e AS (PARTITION BY stem))
    SELECT stem, round(max(abs(cp / nullif(tp, 0) - cq / nullif(tq, 0))), 8) AS ks FROM c GROUP BY stem""",
)
def e07_ks(spark, d):
    return E.ks_distance(labelled(spark, d), "stem", "x", "y").withColumn("ks", r8(F.col("ks")))


@query(
    "e07_quantile_gaps",
    _LAB
    + """SELECT stem, round(quantile_cont(x, 0.5) FILTER (y) - quantile_cont(x, 0.5) FILTER (NOT y), 8) + 0.0 AS qgap_med,
    round(quantile_cont(x, 0.9) FILTER (y) - quantile_cont(x, 0.1) FILTER (NOT y), 8) + 0.0 AS qgap_90_10 FROM lab GROUP BY stem""",
)
def e07_gaps(spark, d):
    """Between the medians, and from the 10 % quantile of the negatives to the 90 % quantile of the positives."""
    g = E.quantile_gaps(labelled(spark, d), "stem", "x", "y")
    return g.select("stem", *[r8(F.col(c)).alias(c) for c in ("qgap_med", "qgap_90_10")])


@query(
    "e07_correlations",
    _PAIR + """, r AS (SELECT *, rank() OVER (PARTITION BY stem ORDER BY a) + (count(*) OVER (PARTITION BY stem, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY stem ORDER BY b) + (count(*) OVER (PARTITION BY stem, b) - 1) / 2.0 AS rb FROM ab)
    SELECT stem, round(corr(a, b), 5) AS pearson, round(corr(ra, rb), 5) AS spearman FROM r GROUP BY stem HAVING count(DISTINCT a) > 1 AND count(DISTINCT b) > 1""",
)
def e07_corr(spark, d):
    ab = pair(spark, d)
    r = E.average_ranks(E.average_ranks(ab, "stem", "a", "ra"), "stem", "b", "rb")
    g = r.groupBy("stem").agg(F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb")).where("na > 1 and nb > 1")
    return g.select("stem", (F.round("pearson", 5) + 0.0).alias("pearson"), (F.round("spearman", 5) + 0.0).alias("spearman"))


@query("e08_roc_points", _SWEEP + "SELECT stem, thr, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr FROM w")
def e08(spark, d):
    return E.roc_points(labelled(spark, d), "stem", "x", "y").select("stem", "thr", r8(F.col("fpr")).alias("fpr"), r8(F.col("tpr")).alias("tpr"))


@query(
    "e09_correlation_matrix",
    SERIES_SQL + """SELECT x.source AS source_a, y.source AS source_b, round(corr(x.energy, y.energy), 5) AS pearson, count(*) AS n FROM s x JOIN s y ON x.stem = y.stem AND x.win = y.win AND x.source < y.source
    GROUP BY 1, 2""",
)
def e09(spark, d):
    s = series(spark, d).select("stem", "win", "source", "energy")
    b = s.select("stem", "win", F.col("source").alias("source_b"), F.col("energy").alias("eb"))
    return s.join(b, ["stem", "win"]).where("source < source_b").groupBy(F.col("source").alias("source_a"), "source_b").agg((F.round(F.corr("energy", "eb"), 5) + 0.0).alias("pearson"), F.count("*").alias("n"))


# --- segments ---------------------------------------------------------------------------------------------------------------


@query("segments_batch", "WITH RECURSIVE " + ALL_LINES_SQL + "," + recursion(ALPHA, RULE) + "SELECT path, i0, i1, round(i0 * 0.4::DOUBLE, 8) AS start_sec, round((i1 + 1) * 0.4::DOUBLE, 8) AS end_sec FROM seg WHERE i1 - i0 + 1 >= 3")
def segments_batch(spark, d):
    """Smoothed, segmented and turned into seconds in one pass over sorted rows."""
    g = G.ema_segments(S.positions(every(spark, d)), ALPHA, RULE).where(F.col("i1") - F.col("i0") + 1 >= 3)
    return G.to_seconds(g, DT).select("path", "i0", "i1", r8(F.col("start_sec")).alias("start_sec"), r8(F.col("end_sec")).alias("end_sec"))


@query("t02_segments_raw", "WITH RECURSIVE " + ALL_LINES_SQL + "," + recursion(None, RULE) + "SELECT path, i0, i1 FROM seg")
def t02(spark, d):
    return G.segment(S.positions(every(spark, d)), RULE).select("path", "i0", "i1")


@query("segments_stream", "WITH RECURSIVE " + ALL_LINES_SQL + "," + recursion(None, STREAM) + "SELECT path, i0, i1, windows FROM seg WHERE windows >= 3")
def t03(spark, d):
    """T03 replayed over a whole table; the streaming job is in stridelake.streaming."""
    return G.segment(S.positions(every(spark, d)), STREAM, min_len=3)


@query(
    "t13_thresholds",
    "SELECT doc_path, coalesce(try_cast(json_extract_string(to_json(segmentation_params), '$.threshold') AS DOUBLE), 1.9327) AS threshold FROM seg_docs",
)
def t13(spark, d):
    j = F.to_json("segmentation_params")
    return load(spark, d, "seg_docs").select("doc_path", F.coalesce(fn.dotted(j, "threshold"), F.lit(1.9327)).alias("threshold"))


@query("pred10_time_slice", SERIES_SQL + "SELECT path, win, round(win * 4.0 / 10.0, 8) AS sec, energy FROM s WHERE win BETWEEN 25 AND 75")
def pred10(spark, d):
    """Energies between 10 s and 30 s (P10, F01, the data of the energy comparison figure)."""
    return S.time_slice(series(spark, d), 10.0, 30.0, STRIDE, FPS).select("path", "win", r8(F.col("sec")).alias("sec"), "energy")
