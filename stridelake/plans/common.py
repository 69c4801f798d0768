"""Inputs shared by the queries, and the same inputs as SQL.

``every`` is the last line of every window of every energy file, ``series`` the same without readings above
``MAX_ENERGY`` and impossible windows; ``ref`` pairs a file with the stem's velocity file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators import series as S
from stridelake.sources.tables import load

STRIDE, FPS, T = 4.0, 10.0, 15
MAX_ENERGY = 10_000.0  # left out of the series of statistics: sums over spikes of 1e12 have no digits in common with the readings
DT = STRIDE / FPS

LINES_SQL = r"""
lines AS (SELECT path, stem, regexp_extract(path, 'stream_energy_(optical_flow|[^_/]+)_([^/]+)\.jsonl$', 1) AS source,
                 regexp_extract(path, 'stream_energy_(optical_flow|[^_/]+)_([^/]+)\.jsonl$', 2) AS mode, win_idx AS win, energy, line_id
          FROM energy WHERE path IS NOT NULL AND energy IS NOT NULL AND NOT isnan(energy) AND NOT isinf(energy) AND energy BETWEEN 0 AND 10000
            AND win_idx BETWEEN 0 AND 49000000),
lastw AS (SELECT path, win, max_by(energy, line_id) AS energy, min(stem) AS stem, min(source) AS source, min(mode) AS mode FROM lines GROUP BY path, win),
s AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY win) - 1 AS i FROM lastw)
"""
SERIES_SQL = "WITH " + LINES_SQL
# The same without any bound: what scans, runs and segments read.
ALL_LINES_SQL = LINES_SQL.replace(" AND energy BETWEEN 0 AND 10000\n            AND win_idx BETWEEN 0 AND 49000000)", " AND win_idx IS NOT NULL)")
ALL_SQL = "WITH " + ALL_LINES_SQL
assert ALL_LINES_SQL != LINES_SQL

DOCS_SQL = r"""
docs AS (SELECT doc_path, regexp_replace(doc_path, '(_|/)(pred_)?segments(_noisy)?\.json$', '') AS unit, regexp_replace(video, '\.mp4$', '') AS stem, doc_kind,
                segments, video_duration_sec, fps, segmentation_params AS sp
         FROM seg_docs WHERE doc_path IS NOT NULL AND video IS NOT NULL AND segments IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY doc_path ORDER BY processed_at DESC NULLS LAST, video, doc_kind) = 1),
gt AS (SELECT * FROM docs WHERE doc_kind IN ('gt', 'gt_noisy') QUALIFY row_number() OVER (PARTITION BY unit ORDER BY doc_kind, doc_path) = 1),
pred AS (SELECT * FROM docs WHERE doc_kind = 'pred' QUALIFY row_number() OVER (PARTITION BY unit ORDER BY doc_path) = 1)
"""


def every_line(spark: SparkSession, d: str) -> DataFrame:
    return S.clean_lines(load(spark, d, "energy"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines statistics are taken of: without readings and counters that cannot be right."""
    return S.clean_lines(load(spark, d, "energy"), windows=(0, 49_000_000), energies=(0.0, MAX_ENERGY))


def every(spark: SparkSession, d: str) -> DataFrame:
    return S.keep_per_window(every_line(spark, d))


def series(spark: SparkSession, d: str) -> DataFrame:
    return S.keep_per_window(lines(spark, d))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Segment documents, one per path (the one processed last), with unit and stem."""
    t = load(spark, d, "seg_docs").where("doc_path is not null and video is not null and segments is not null")
    body = F.struct(F.regexp_replace("video", r"\.mp4$", "").alias("stem"), "doc_kind", "segments", "video_duration_sec", "fps", F.col("segmentation_params").alias("sp"))
    # the latest; among equals the smallest video and kind
    rank = F.struct("processed_at", "video", "doc_kind")
    latest = t.groupBy("doc_path").agg(F.max("processed_at").alias("at"))
    t = t.join(latest, "doc_path").where(F.col("processed_at").eqNullSafe(F.col("at")))
    t = t.groupBy("doc_path").agg(F.min_by(body, rank).alias("b"))
    unit = F.regexp_replace("doc_path", r"(_|/)(pred_)?segments(_noisy)?\.json$", "")
    return t.select("doc_path", unit.alias("unit"), "b.*")


def ground_truth(docs: DataFrame) -> DataFrame:
    """Clean ground truth before noisy, per unit."""
    body = F.struct("doc_path", "stem", "doc_kind", "segments", "video_duration_sec", "fps")
    return docs.where(F.col("doc_kind").isin("gt", "gt_noisy")).groupBy("unit").agg(F.min_by(body, F.struct("doc_kind", "doc_path")).alias("b")).select("unit", "b.*")


def predictions(docs: DataFrame) -> DataFrame:
    body = F.struct("doc_path", "stem", "segments", "video_duration_sec", "fps", "sp")
    return docs.where("doc_kind = 'pred'").groupBy("unit").agg(F.min_by(body, F.col("doc_path")).alias("b")).select("unit", "b.*")


NUDGE = 3.3e-11


def r8(c):
    """Rounded to 8 places without a negative zero.

    Means of values with 6 places can fall on an exact half of the ninth place; the nudge keeps such halves from being
    rounded by the last bit of a sum, whose order differs between engines.
    """
    return F.round(c + F.lit(NUDGE), 8) + F.lit(0.0)


def nudged(sql: str) -> str:
    """The same nudge in every ``round(..., 8)`` of an SQL text."""
    out, at = [], 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j = 0, i + 5
        while True:
            depth += (sql[j] == "(") - (sql[j] == ")")
            if depth == 0:
                break
            j += 1
        out.append(sql[at : i + 6])
        body = nudged(sql[i + 6 : j])
        out.append(f"{body[:-3]} + {NUDGE}, 8" if body.endswith(", 8") else body)
        at = j
    return "".join(out) + sql[at:]
