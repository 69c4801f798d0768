"""Queries on segment documents and their evaluation, window export and quality of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.functions import scalars as fn
from stridelake.operators import evaluate as E
from stridelake.operators import segmenter as G
from stridelake.operators import series as S
from stridelake.plans.common import DOCS_SQL, DT, FPS, LINES_SQL, SERIES_SQL, STRIDE, T, documents, ground_truth, predictions, r8, series
from stridelake.plans.energy import recursion
from stridelake.sources.tables import load, materialise

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


DOCS = "WITH " + DOCS_SQL
NO_END = 1e9  # duration where none is known


@query("s07_segment_rows", DOCS + "SELECT doc_path, x.start_sec AS start_sec, x.end_sec AS end_sec, x.label AS label FROM (SELECT doc_path, unnest(segments) AS x FROM docs)")
def s07(spark, d):
    return documents(spark, d).select("doc_path", F.explode("segments").alias("x")).select("doc_path", "x.start_sec", "x.end_sec", "x.label")


@query("s08_ground_truth", DOCS + "SELECT unit, doc_path, doc_kind, len(segments) AS n FROM gt")
def s08(spark, d):
    return ground_truth(documents(spark, d)).select("unit", "doc_path", "doc_kind", F.size("segments").cast("long").alias("n"))


@query(
    "f03_boundaries",
    DOCS + """, b AS (SELECT unit, coalesce(video_duration_sec, 1e9) AS dur, unnest(segments) AS x FROM gt)
    SELECT unit, v AS boundary FROM (SELECT unit, x.start_sec AS v FROM b WHERE x.start_sec > 0 UNION ALL SELECT unit, x.end_sec FROM b WHERE x.end_sec < dur)""",
)
def f03(spark, d):
    g = ground_truth(documents(spark, d))
    return g.select("unit", F.explode(E.boundaries(F.col("segments"), F.coalesce("video_duration_sec", F.lit(NO_END)))).alias("boundary"))


def boundary_pairs(spark, d):
    """Boundaries of truth and prediction per unit; a unit without prediction has none."""
    docs = documents(spark, d)
    g, p = ground_truth(docs), predictions(docs).select("unit", F.col("segments").alias("ps"))
    j = g.join(p, "unit", "left")
    dur = F.coalesce("video_duration_sec", F.lit(NO_END))
    none = F.array().cast("array<double>")
    return j.select("unit", E.boundaries(F.col("segments"), dur).alias("gt"), F.coalesce(E.boundaries(F.col("ps"), dur), none).alias("pred"), F.col("ps").isNull().alias("missing"))


_BOUNDS = """list_sort(list_concat(list_filter(list_transform({s}, lambda x: x.start_sec), lambda v: v > 0), list_filter(list_transform({s}, lambda x: x.end_sec), lambda v: v < {dur})))"""
_F1 = (
    "WITH RECURSIVE "
    + DOCS_SQL
    + f""", bp AS (SELECT g.unit, {_BOUNDS.format(s='g.segments', dur='coalesce(g.video_duration_sec, 1e9)')} AS gt,
      coalesce({_BOUNDS.format(s='p.segments', dur='coalesce(g.video_duration_sec, 1e9)')}, []) AS pred FROM gt g LEFT JOIN pred p ON g.unit = p.unit),
    tols AS (SELECT unnest([2.0::DOUBLE, 5.0::DOUBLE]) AS tol),
    m AS (SELECT unit, tol, gt, pred, 0::BIGINT AS k, []::BIGINT[] AS used FROM bp, tols
      UNION ALL
      SELECT unit, tol, gt, pred, k + 1, CASE WHEN best IS NOT NULL AND offs[best] <= tol THEN list_append(used, best) ELSE used END FROM (
        SELECT *, list_position(offs, list_min(offs))::BIGINT AS best FROM (
          SELECT *, list_transform(range(1, len(pred) + 1), lambda j: CASE WHEN list_contains(used, j) THEN 1e18 ELSE abs(pred[j] - gt[k + 1]) END) AS offs FROM m WHERE k < len(gt)) a) b),
    done AS (SELECT unit, tol, len(used) AS tp, len(gt) AS n_gt, len(pred) AS n_pred FROM m WHERE k = len(gt)),
    pr AS (SELECT *, CASE WHEN n_gt = 0 THEN 1.0 WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred END AS precision,
      CASE WHEN n_gt = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END ELSE tp / n_gt END AS recall FROM done),
    sc AS (SELECT *, CASE WHEN n_gt = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)
    """
)


@query("v01_boundary_f1", _F1 + "SELECT unit, tol, tp, n_gt, n_pred, round(precision::DOUBLE, 8) AS precision, round(recall::DOUBLE, 8) AS recall, round(f1::DOUBLE, 8) AS f1 FROM sc")
def v01(spark, d):
    """Greedy one-to-one matching within 2 s and 5 s."""
    f = E.f1_at_tolerance(boundary_pairs(spark, d), [2.0, 5.0])
    return f.select("unit", "tol", "tp", "n_gt", "n_pred", *[r8(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("v03_macro_scores", _F1 + "SELECT tol, round(avg(precision::DOUBLE), 8) AS precision, round(avg(recall::DOUBLE), 8) AS recall, round(avg(f1::DOUBLE), 8) AS f1, count(*) AS n_units FROM sc GROUP BY tol")
def v03(spark, d):
    """Means over all units; those without a prediction score 0."""
    m = E.macro_average(E.f1_at_tolerance(boundary_pairs(spark, d), [2.0, 5.0]), ["tol"], ["precision", "recall", "f1"])
    return m.select("tol", *[r8(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "n_units")


@query("j04_missing_predictions", DOCS + "SELECT unit FROM gt WHERE unit NOT IN (SELECT unit FROM pred)")
def j04(spark, d):
    docs = documents(spark, d)
    return ground_truth(docs).join(predictions(docs), "unit", "left_anti").select("unit")


def numbered(docs):
    """Segments of documents as rows with their number."""
    return docs.select("unit", "stem", F.posexplode("segments").alias("seg_no", "x")).select("unit", "stem", F.col("seg_no").cast("long").alias("seg_no"), "x.start_sec", "x.end_sec")


_PS = """, ps AS (SELECT unit, stem, n - 1 AS seg_no, x.start_sec AS start_sec, x.end_sec AS end_sec FROM (SELECT unit, stem, unnest(segments) AS x, generate_subscripts(segments, 1) AS n FROM pred)),
gs AS (SELECT unit, stem, n - 1 AS seg_no, x.start_sec AS start_sec, x.end_sec AS end_sec FROM (SELECT unit, stem, unnest(segments) AS x, generate_subscripts(segments, 1) AS n FROM gt)),
conf AS (SELECT ps.unit, ps.seg_no, any_value(ps.start_sec) AS start_sec, any_value(ps.end_sec) AS end_sec, round(coalesce(avg(s.energy), any_value(ps.end_sec - ps.start_sec)), 8) AS conf
  FROM ps LEFT JOIN s ON s.stem = ps.stem AND s.win * 4.0::DOUBLE / 10.0::DOUBLE BETWEEN ps.start_sec AND ps.end_sec GROUP BY ps.unit, ps.seg_no)
"""


def confidences(spark, d):
    p = numbered(predictions(documents(spark, d)))
    return E.segment_confidence(p, series(spark, d), STRIDE, FPS).withColumn("conf", r8(F.col("conf")))


@query("j05_segment_confidence", SERIES_SQL + "," + DOCS_SQL + _PS + "SELECT unit, seg_no, conf FROM conf")
def j05(spark, d):
    """Mean energy over all energy files of the stem within the segment."""
    return confidences(spark, d).select("unit", "seg_no", "conf")


@query(
    "f02_iou_pairs",
    DOCS + _PS.split("conf AS (")[0].rstrip().rstrip(",") + """
    SELECT p.unit, p.seg_no AS a_no, g.seg_no AS b_no, round((least(p.end_sec, g.end_sec) - greatest(p.start_sec, g.start_sec)) / greatest(1e-8, (p.end_sec - p.start_sec) + (g.end_sec - g.start_sec) - (least(p.end_sec, g.end_sec) - greatest(p.start_sec, g.start_sec))), 8) AS iou
    FROM ps p JOIN gs g ON p.unit = g.unit AND p.start_sec < g.end_sec AND g.start_sec < p.end_sec""",
)
def f02(spark, d):
    docs = documents(spark, d)
    return E.iou_pairs(numbered(predictions(docs)), numbered(ground_truth(docs))).withColumn("iou", r8(F.col("iou")))


_DET = (
    "WITH RECURSIVE "
    + LINES_SQL
    + ","
    + DOCS_SQL
    + _PS
    + """, thr AS (SELECT unnest([0.5::DOUBLE, 0.75::DOUBLE]) AS iou),
r AS (SELECT conf.*, row_number() OVER (PARTITION BY unit ORDER BY conf DESC, seg_no) AS k FROM conf WHERE unit IN (SELECT unit FROM gt)),
d AS (SELECT unit, iou, 0::BIGINT AS k, []::BIGINT[] AS used, 0::BIGINT AS tp, segments FROM gt, thr
  UNION ALL
  SELECT unit, iou, k, CASE WHEN hit THEN list_append(used, best) ELSE used END, CASE WHEN hit THEN 1 ELSE 0 END, segments FROM (
    SELECT *, best IS NOT NULL AND ious[best] > 0 AND ious[best] >= iou AS hit FROM (SELECT *, list_position(ious, list_max(ious))::BIGINT AS best FROM (
      SELECT d.unit, d.iou, r.k, d.used, d.segments, list_transform(range(1, len(d.segments) + 1), lambda j: CASE WHEN list_contains(d.used, j) THEN -1.0 ELSE
        greatest(0, least(r.end_sec, d.segments[j].end_sec) - greatest(r.start_sec, d.segments[j].start_sec)) / greatest(1e-8, (r.end_sec - r.start_sec) + (d.segments[j].end_sec - d.segments[j].start_sec)
        - greatest(0, least(r.end_sec, d.segments[j].end_sec) - greatest(r.start_sec, d.segments[j].start_sec))) END) AS ious
      FROM d JOIN r ON r.unit = d.unit AND r.k = d.k + 1) a) b) c),
det AS (SELECT d.iou, d.unit, r.seg_no, r.conf, d.tp FROM d JOIN r ON r.unit = d.unit AND r.k = d.k)
"""
)


def detections(spark, d):
    g = ground_truth(documents(spark, d))
    return E.detections(g.select("unit", F.col("segments").alias("segs")), confidences(spark, d), [0.5, 0.75]), g


@query("j09_detections", _DET + "SELECT iou, unit, seg_no, conf, tp FROM det")
def j09(spark, d):
    return detections(spark, d)[0].select("iou", "unit", "seg_no", "conf", "tp")


@query(
    "v02_map_iou",
    _DET
    + """, n AS (SELECT sum(len(segments)) AS npos FROM gt), c AS (SELECT iou, tp, sum(tp) OVER w AS t, row_number() OVER w AS k, unit, seg_no, conf FROM det WINDOW w AS (PARTITION BY iou ORDER BY conf DESC, unit, seg_no)),
    e AS (SELECT iou, tp, max(t / k) OVER (PARTITION BY iou ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM c)
    SELECT iou, round(sum(tp * env / (SELECT npos FROM n)), 8) AS ap FROM e GROUP BY iou""",
)
def v02(spark, d):
    """Mean average precision at IoU 0.5 and 0.75."""
    dets, g = detections(spark, d)
    dets = materialise(dets, "detections")  # read four times
    npos = g.agg(F.sum(F.size("segments")).alias("npos"))
    return E.average_precision(dets, npos).select("iou", r8(F.col("ap")).alias("ap"))


@query("u05_tolerances", "SELECT list_sort(list_distinct([5.0::DOUBLE, 2.0::DOUBLE, 2.0::DOUBLE])) AS tols")
def u05(spark, d):
    return spark.range(1).select(F.array_sort(F.array_distinct(F.array(F.lit(5.0), F.lit(2.0), F.lit(2.0)))).alias("tols"))


# --- threshold search with ground truth -----------------------------------------------------------------------------------


def _search_inputs(spark, d):
    """Stride means of the quantized stream of every unit with ground truth whose document covers one stem."""
    g = ground_truth(documents(spark, d)).where("unit not like '%chunk%'")
    s = series(spark, d).where("source = 'quantized'")
    x = S.stride_mean(s, 2).withColumnRenamed("g", "i")
    stems = s.groupBy("path").agg(F.min("stem").alias("stem"), F.count("*").alias("n"))
    return g.join(stems, "stem"), x


@query("v04_threshold_search")
def v04(spark, d):
    """All candidates of all videos at once: fold each (series, threshold), match, average, pick the best."""
    g, x = _search_inputs(spark, d)
    x = materialise(x.join(g.select("path"), "path", "left_semi"), "series")  # read for the candidates and for the segments
    pooled = x.select(F.lit("all").alias("path"), F.col("i").alias("win"), "energy")
    thr = E.candidates(pooled).select(F.round("thr", 6).alias("on")).distinct()
    ons = sorted(r[0] for r in thr.collect())  # 11 values at most: 5 quantiles, 4 midpoints, 2 extremes
    thr = spark.createDataFrame([(v,) for v in ons], "on double")
    seg = G.to_seconds(G.segment_many(x, ons), DT * 2).withColumn("run", F.concat_ws("|", "path", "on"))
    seg = seg.where(F.col("i1") - F.col("i0") + 1 >= 3).groupBy("run").agg(F.collect_list(F.struct("start_sec", "end_sec")).alias("ps"))
    keys = g.select("unit", "path", "segments", F.coalesce("video_duration_sec", F.col("n") * DT).alias("dur")).crossJoin(F.broadcast(thr)).withColumn("run", F.concat_ws("|", "path", "on"))
    none = F.array().cast("array<double>")
    pairs = keys.join(seg, "run", "left").select(F.concat_ws("|", "unit", "on").alias("unit"), E.boundaries(F.col("segments"), F.col("dur")).alias("gt"), F.coalesce(E.boundaries(F.col("ps"), F.col("dur")), none).alias("pred"))
    sc = E.f1_at_tolerance(pairs, [2.0]).withColumn("thr", F.substring_index("unit", "|", -1).cast("double"))
    m = E.macro_average(sc, ["thr"], ["f1", "precision", "recall"])
    return m.orderBy(F.desc(F.round("f1", 9)), F.desc(F.round("precision", 9)), F.desc("thr")).limit(1)


# --- windows and segments -----------------------------------------------------------------------------------------------------

_FW = """fw AS (SELECT doc_path, w AS win, w * 4 + 1 AS ws, w * 4 + 15 AS we FROM (SELECT doc_path, unnest(range(0, CAST(floor((floor(video_duration_sec * 10) - 15) / 4) AS BIGINT))) AS w FROM seg_docs WHERE video_duration_sec IS NOT NULL AND doc_kind = 'gt'))"""


def _frame_windows(spark, d):
    t = load(spark, d, "seg_docs").where("video_duration_sec is not null and doc_kind = 'gt'")
    frames = F.floor(F.col("video_duration_sec") * FPS).cast("long")
    return t.select("doc_path", F.explode(G.frame_windows(frames, T, int(STRIDE))).alias("w")).select("doc_path", "w.*")


@query("w01_frame_windows", "WITH " + _FW + " SELECT doc_path, win, ws, we FROM fw")
def w01(spark, d):
    return _frame_windows(spark, d)


@query("w02_offline_windows", "SELECT doc_path, n AS win, n * 4 AS ws, n * 4 + 14 AS we FROM (SELECT doc_path, unnest(range(0, CAST(floor((floor(video_duration_sec * 10) - 15) / 4) + 1 AS BIGINT))) AS n FROM seg_docs WHERE video_duration_sec IS NOT NULL AND doc_kind = 'pred')")
def w02(spark, d):
    t = load(spark, d, "seg_docs").where("video_duration_sec is not null and doc_kind = 'pred'")
    frames = F.floor(F.col("video_duration_sec") * FPS).cast("long")
    return t.select("doc_path", F.explode(G.frame_windows(frames, T, int(STRIDE), phase=0)).alias("w")).select("doc_path", "w.*")


@query("w03_padded_windows", "SELECT t AS start_t, h, least(t + h, 9) AS frame FROM range(0, 10) a(t), range(0, 4) b(h)")
def w03(spark, d):
    """One window per frame of a clip of 10, padded with its last frame."""
    t = spark.range(10).select(F.col("id").alias("start_t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("h"))
    return t.withColumn("frame", F.least(F.col("start_t") + F.col("h"), F.lit(9)))


_GEO = "geo AS (SELECT seg_id, any_value(segment.start_frame) AS sf, any_value(segment.end_frame) AS ef FROM seg_codes WHERE segment.start_frame IS NOT NULL AND segment.end_frame IS NOT NULL GROUP BY seg_id)"


def _segments(spark, d):
    t = load(spark, d, "seg_codes").where("segment.start_frame is not null and segment.end_frame is not null")
    return t.groupBy("seg_id").agg(F.min("stem").alias("path"), F.min("segment.start_frame").cast("long").alias("start_frame"), F.min("segment.end_frame").cast("long").alias("end_frame"))


@query(
    "j06_window_overlap",
    f"""WITH {_GEO.replace("any_value", "min")}, x AS (SELECT seg_id, sf, ef, unnest(range(greatest(0, (sf - 20) // 4), ef // 4 + 2)) AS w FROM geo),
    o AS (SELECT seg_id, w AS win, greatest(0, least(w * 4 + 15, ef) - greatest(w * 4 + 1, sf) + 1) AS overlap FROM x)
    SELECT seg_id, win, overlap FROM o WHERE overlap > 0 AND overlap / 15.0 >= 0.5""",
)
def j06(spark, d):
    """Windows that lie in a segment by at least half."""
    s = _segments(spark, d).withColumn("path", F.col("seg_id").cast("string"))
    w = s.select("path", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("start_frame") - 20) / 4).cast("long")), F.floor(F.col("end_frame") / 4).cast("long") + 1)).alias("win"))
    w = w.select("path", "win", (F.col("win") * 4 + 1).alias("ws"), (F.col("win") * 4 + 15).alias("we"))
    return G.export_windows(s, w, T, 0.5).select("seg_id", "win", F.col("overlap").cast("long").alias("overlap"))


@query(
    "j07_non_overlapping",
    f"""WITH RECURSIVE {_GEO.replace("any_value", "min")}, x AS (SELECT seg_id, sf, ef, unnest(range(greatest(0, (sf - 20) // 4), ef // 4 + 2)) AS w FROM geo),
    o AS (SELECT seg_id, w, w * 4 + 1 AS ws, w * 4 + 15 AS we FROM x WHERE greatest(0, least(w * 4 + 15, ef) - greatest(w * 4 + 1, sf) + 1) / 15.0 >= 0.5),
    g AS (SELECT seg_id, min(w) AS w FROM o GROUP BY seg_id UNION ALL SELECT g.seg_id, (SELECT min(o.w) FROM o WHERE o.seg_id = g.seg_id AND o.ws > g.w * 4 + 15) FROM g WHERE g.w IS NOT NULL)
    SELECT seg_id, w AS win FROM g WHERE w IS NOT NULL""",
)
def j07(spark, d):
    s = _segments(spark, d).withColumn("path", F.col("seg_id").cast("string"))
    w = s.select("path", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("start_frame") - 20) / 4).cast("long")), F.floor(F.col("end_frame") / 4).cast("long") + 1)).alias("win"))
    w = w.select("path", "win", (F.col("win") * 4 + 1).alias("ws"), (F.col("win") * 4 + 15).alias("we"))
    return G.non_overlapping(G.export_windows(s, w, T, 0.5)).select("seg_id", "win")


@query(
    "w10_code_export",
    """WITH one AS (SELECT * FROM seg_codes WHERE segment.start_frame IS NOT NULL AND segment.end_frame IS NOT NULL AND codes_windows IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY exported_at) = 1),
    x AS (SELECT seg_id, segment.start_frame AS sf, segment.end_frame AS ef, unnest(selected_win_idxs) AS win, unnest(codes_windows) AS codes FROM one),
    o AS (SELECT seg_id, win, codes FROM x WHERE win IS NOT NULL AND greatest(0, least(win * 4 + 15, ef) - greatest(win * 4 + 1, sf) + 1) / 15.0 >= 0.25)
    SELECT seg_id, count(*) AS n_windows, list_aggregate(flatten(list(codes ORDER BY win)), 'string_agg', ' ') AS codes FROM o GROUP BY seg_id HAVING count(*) > 1""",
)
def w10(spark, d):
    """J06 by frames, P08 (more than one window), codes in the order of the windows."""
    t = load(spark, d, "seg_codes").where("segment.start_frame is not null and segment.end_frame is not null and codes_windows is not null")
    t = t.groupBy("seg_id").agg(F.min_by(F.struct("segment", "selected_win_idxs", "codes_windows"), F.col("exported_at")).alias("b")).select("seg_id", "b.*")
    rows = t.select("seg_id", "segment", F.explode(F.arrays_zip(F.col("selected_win_idxs").alias("win"), F.col("codes_windows").alias("codes"))).alias("z")).select("seg_id", "segment.start_frame", "segment.end_frame", "z.win", "z.codes").where("win is not null")
    over = F.greatest(F.lit(0), F.least(F.col("win") * 4 + 15, F.col("end_frame")) - F.greatest(F.col("win") * 4 + 1, F.col("start_frame")) + 1)
    g = rows.where(over / F.lit(15.0) >= 0.25).groupBy("seg_id").agg(F.sort_array(F.collect_list(F.struct("win", "codes"))).alias("w")).where(F.size("w") > 1)  # windows of one segment
    return g.select("seg_id", F.size("w").cast("long").alias("n_windows"), F.concat_ws(" ", F.flatten("w.codes").cast("array<string>")).alias("codes"))


@query(
    "t09_segment_frames",
    """SELECT seg_id, min(segment.start_win * 4 + 1 + 7) AS center, min(segment.start_win * 4 + 15 - 4 + 1) AS at_end, min(segment.start_win * 4 + 1) AS at_start, round(min(segment.start_frame / 10.0::DOUBLE), 8) AS start_sec,
    round(min(segment.start_frame / 10.0::DOUBLE + (segment.end_frame - segment.start_frame + 1) / 10.0::DOUBLE), 8) AS end_sec FROM seg_codes WHERE segment.start_win IS NOT NULL AND segment.start_frame IS NOT NULL AND segment.end_frame IS NOT NULL GROUP BY seg_id""",
)
def t09(spark, d):
    """First frames by alignment, and seconds."""
    t = load(spark, d, "seg_codes").where("segment.start_win is not null and segment.start_frame is not null and segment.end_frame is not null")
    ws = F.col("segment.start_win").cast("long") * 4 + 1
    times = G.segment_times(F.col("segment.start_frame"), F.col("segment.end_frame"), FPS)
    starts = [F.min(G.start_frame(ws, ws + 14, how, T, 4)).alias(n) for how, n in (("center", "center"), ("end", "at_end"), ("start", "at_start"))]
    return t.groupBy("seg_id").agg(*starts, r8(F.min(times["start_sec"])).alias("start_sec"), r8(F.min(times["end_sec"])).alias("end_sec"))


@query("pred07_min_length", "WITH RECURSIVE " + LINES_SQL + "," + recursion(None, G.Rule(on=2.0, cooldown=2)) + "SELECT path, i0, i1 FROM seg WHERE i1 - i0 + 1 >= 5")
def pred07(spark, d):
    return G.segment(S.positions(series(spark, d)), G.Rule(on=2.0, cooldown=2), min_len=5).select("path", "i0", "i1")


@query("pred09_visible_segments", DOCS + _PS.split("conf AS (")[0].rstrip().rstrip(",") + "SELECT unit, seg_no FROM ps WHERE NOT (end_sec < 10 OR start_sec > 60)")
def pred09(spark, d):
    return numbered(predictions(documents(spark, d))).where("not (end_sec < 10 or start_sec > 60)").select("unit", "seg_no")


# --- documents as data: timebase, plans, formats ----------------------------------------------------------------------------------


@query(
    "q14_timebase",
    """WITH f AS (SELECT doc_path, segments, video_duration_sec AS dur, coalesce(CASE WHEN fps > 0 AND NOT isnan(fps) THEN fps END, CASE WHEN segmentation_params.orig_fps > 0 AND NOT isnan(segmentation_params.orig_fps) THEN segmentation_params.orig_fps END) AS orig,
    CASE WHEN segmentation_params.target_fps > 0 THEN segmentation_params.target_fps ELSE 10.0 END AS target FROM seg_docs),
    g AS (SELECT *, CASE WHEN segments IS NULL THEN 'error_no_segments' WHEN orig IS NULL THEN 'skip_no_fps' WHEN abs(orig - target) < 1e-6 THEN 'skip_same_fps' ELSE 'ok' END AS status FROM f)
    SELECT doc_path, status, round(CASE WHEN status = 'ok' THEN target / orig END, 8) AS scale,
    round(CASE WHEN status = 'ok' THEN list_max(list_transform(segments, lambda x: x.end_sec * target / orig)) END, 8) AS max_end,
    CASE WHEN status = 'ok' THEN coalesce(list_max(list_transform(segments, lambda x: x.end_sec * target / orig)) > dur + 1e-6, false) END AS too_long FROM g""",
)
def q14(spark, d):
    """repair of times that were taken at the wrong frame rate, with a status per document."""
    from stridelake.operators.quality import timebase_repair

    t = timebase_repair(load(spark, d, "seg_docs"), FPS)
    return t.select("doc_path", "status", r8(F.col("scale")).alias("scale"), r8(F.array_max(F.transform("fixed", lambda x: x["end_sec"]))).alias("max_end"), "too_long")


@query(
    "f15_split_plan",
    """SELECT doc_path, n - 1 AS part, (n - 1) * 60.0::DOUBLE AS start_sec, least(n * 60.0::DOUBLE, dur) AS end_sec FROM (SELECT doc_path, video_duration_sec AS dur, unnest(range(1, CAST(ceil(video_duration_sec / 60.0) AS BIGINT) + 1)) AS n FROM seg_docs WHERE video_duration_sec > 60.01)""",
)
def f15(spark, d):
    t = load(spark, d, "seg_docs").where("video_duration_sec is not null")
    return t.select("doc_path", F.posexplode(fn.split_plan(F.col("video_duration_sec"), 60.0)).alias("part", "x")).select("doc_path", F.col("part").cast("long").alias("part"), "x.*")


@query("f14_clock", "SELECT doc_path, printf('%02d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS clock FROM (SELECT doc_path, CAST(round_even(video_duration_sec * 1000, 0) AS BIGINT) AS ms FROM seg_docs WHERE video_duration_sec IS NOT NULL)")
def f14(spark, d):
    return load(spark, d, "seg_docs").where("video_duration_sec is not null").select("doc_path", fn.clock(F.col("video_duration_sec")).alias("clock"))


@query("f01_times", SERIES_SQL + "SELECT path, win, round(win * 4.0::DOUBLE / 10.0, 8) AS sec, CAST(round_even((win * 0.37::DOUBLE) * 10.0 / 4.0, 0) AS BIGINT) AS win_of FROM s")
def f01(spark, d):
    return series(spark, d).select("path", "win", r8(fn.window_to_sec(F.col("win"), F.lit(STRIDE), F.lit(FPS))).alias("sec"), fn.sec_to_window(F.col("win") * 0.37, F.lit(STRIDE), F.lit(FPS)).alias("win_of"))


@query("f09_names", "SELECT doc_path, regexp_replace(regexp_extract(doc_path, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem, printf('segment_%04d_startwin_%06d', len(segments), 7) AS name FROM seg_docs WHERE doc_path IS NOT NULL AND segments IS NOT NULL")
def f09(spark, d):
    """names from templates, stems from paths."""
    t = load(spark, d, "seg_docs").where("doc_path is not null and segments is not null")
    return t.select("doc_path", fn.stem(F.col("doc_path")).alias("stem"), fn.segment_file(F.size("segments"), F.lit(7)).alias("name"))


@query("k04_segment_json")
def k04(spark, d):
    """Final segment documents as JSON text, labels from 0."""
    seg = QUERIES_segments(spark, d)
    from stridelake.sources.writers import segment_documents

    return segment_documents(seg)


def QUERIES_segments(spark, d):
    return G.to_seconds(G.segment(S.positions(series(spark, d)), G.Rule(on=1.0, max_windows=40), min_len=3), DT)
