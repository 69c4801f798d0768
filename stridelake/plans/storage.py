"""Queries that write with a sink and read back with a reader: what comes back must be what the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators.series import finite
from stridelake.plans import energy as energy_plans
from stridelake.plans import evaluation as evaluation_plans
from stridelake.plans.common import ALL_SQL, every
from stridelake.sources import readers, writers
from stridelake.sources.tables import load, materialise, shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


_USABLE = "win_idx IS NOT NULL AND energy IS NOT NULL AND NOT isnan(energy) AND NOT isinf(energy) AND source IS NOT NULL AND mode IS NOT NULL"


def _usable(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "energy").where(F.col("win_idx").isNotNull() & finite(F.col("energy")) & F.col("source").isNotNull() & F.col("mode").isNotNull())
    return e.select(F.col("win_idx").alias("window"), "energy", "source", "mode")


@query("k01_energy_lines", f"SELECT win_idx, energy, source, mode FROM energy WHERE {_USABLE}")
def k01(spark, d):
    """One JSON object a line, read as native energy files are."""
    root = shared_dir(spark)
    writers.write_jsonl(_usable(spark, d), root)
    return readers.energy_files(spark, root, "*.json").select("win_idx", "energy", "source", "mode")


@query(
    "k01_code_lines",
    """SELECT CAST(w AS BIGINT) AS win, CAST(len(c) AS BIGINT) AS n, CAST(coalesce(list_sum(c), 0) AS BIGINT) AS total
    FROM (SELECT unnest(codes_windows) AS c, generate_subscripts(codes_windows, 1) AS w FROM seg_codes) WHERE c IS NOT NULL""",
)
def k01_codes(spark, d):
    """Code lines of all segments in one batch."""
    root = shared_dir(spark)
    rows = load(spark, d, "seg_codes").select(F.posexplode("codes_windows").alias("p", "codes")).where("codes is not null")
    writers.write_jsonl(rows.select((F.col("p") + 1).cast("long").alias("window"), "codes"), root)
    t = readers.code_files(spark, root, "*.json")
    return t.select(F.col("window").alias("win"), F.size("codes").cast("long").alias("n"), F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c, F.lit(0))).alias("total"))


@query("s06_folders", f"SELECT DISTINCT mode FROM energy WHERE {_USABLE}")
def s06(spark, d):
    """Files found in the folders below a root, by extension, without reading them."""
    root = shared_dir(spark)
    writers.write_jsonl(_usable(spark, d), root, ["mode"])
    return readers.listing(spark, root, [".JSON"]).select(F.regexp_extract("path", "/mode=([^/]+)/", 1).alias("mode")).distinct()


@query(
    "k05_sidecars",
    """SELECT video_segment_path, align, segment.start_frame AS start_frame, win_geom.stride AS stride, CAST(len(codes_windows) AS BIGINT) AS n_windows,
    CAST(len(selected_win_idxs) AS BIGINT) AS n_selected FROM seg_codes WHERE video_segment_path IS NOT NULL""",
)
def k05(spark, d):
    """Sidecar documents, one a line, and the same schema on the way back."""
    t = load(spark, d, "seg_codes").where("video_segment_path is not null")
    geom = F.struct(F.col("win_geom.t").alias("T"), "win_geom.stride", "win_geom.target_fps").alias("window")
    doc = F.struct("codes_windows", "selected_win_idxs", "overlap_ratio_threshold", "segment", geom, "align", "video_segment_path", "source", "allow_overlap")
    root = shared_dir(spark)
    t.select(F.to_json(doc).alias("value")).write.text(root)
    back = spark.read.schema(readers.SIDECAR).json(root)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c).cast("long"))
    return back.select("video_segment_path", "align", "segment.start_frame", "window.stride", size("codes_windows").alias("n_windows"), size("selected_win_idxs").alias("n_selected"))


def _report(df: DataFrame, fmt: str) -> DataFrame:
    root = shared_dir(df.sparkSession)
    writers.write_report(df, root, fmt)
    r = df.sparkSession.read.schema(df.schema)
    return r.option("header", "true").csv(root) if fmt == "csv" else r.json(root)


@query("k07_summary", energy_plans.ORACLE_SQL["a10_latency"])
def k07(spark, d):
    """The latency summary as JSON."""
    return _report(energy_plans.QUERIES["a10_latency"](spark, d), "json")


@query("k08_report", ALL_SQL + "SELECT path, count(*) AS n, min(energy) AS lowest, max(energy) AS highest FROM s GROUP BY path")
def k08(spark, d):
    """A table of metrics as CSV."""
    return _report(every(spark, d).groupBy("path").agg(F.count("*").alias("n"), F.min("energy").alias("lowest"), F.max("energy").alias("highest")), "csv")


@query("k10_timebase_report", evaluation_plans.ORACLE_SQL["q14_timebase"])
def k10(spark, d):
    return _report(evaluation_plans.QUERIES["q14_timebase"](spark, d), "csv")


@query("k11_written_once", "SELECT view_name, count(*) AS n FROM (SELECT DISTINCT file, view_name FROM tracks WHERE file IS NOT NULL AND view_name IS NOT NULL) GROUP BY view_name")
def k11(spark, d):
    """What the target holds is skipped, whatever is asked for again."""
    root = shared_dir(spark)
    t = load(spark, d, "tracks").where("file is not null and view_name is not null").select("file", "view_name").distinct()
    writers.write_missing(t.where("view_name = 'agentview'"), root, ["file", "view_name"])
    writers.write_missing(t, root, ["file", "view_name"])
    writers.write_missing(t, root, ["file", "view_name"])
    return spark.read.schema(t.schema).parquet(root).groupBy("view_name").agg(F.count("*").alias("n"))


@query(
    "s20_paired_videos",
    r"""WITH f AS (SELECT DISTINCT stem FROM seg_codes WHERE stem IS NOT NULL), v AS (SELECT DISTINCT video FROM seg_docs WHERE video LIKE '%.mp4')
    SELECT 'codes/' || f.stem || '.codes.json' AS path, min('videos/' || v.video) AS video FROM f LEFT JOIN v ON v.video = f.stem || '.mp4' GROUP BY f.stem""",
)
def s20(spark, d):
    f = load(spark, d, "seg_codes").where("stem is not null").select(F.concat(F.lit("codes/"), "stem", F.lit(".codes.json")).alias("path")).distinct()
    v = load(spark, d, "seg_docs").where("video like '%.mp4'").select(F.concat(F.lit("videos/"), "video").alias("path")).distinct()
    return readers.paired(f, v, "videos")


@query("s21_cached_features", "SELECT CAST(label AS BIGINT) AS label, count(*) AS n, min(vec_id) AS first_id FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL GROUP BY label")
def s21(spark, d):
    """Features and labels written once and read again."""
    t = materialise(load(spark, d, "embeddings").where("embedding is not null and label is not null").select("vec_id", "label", "embedding"), "features")
    return t.groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
