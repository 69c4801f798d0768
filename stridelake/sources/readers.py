"""Readers of the native files: JSON lines, segment documents, sidecars, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.functions.scalars import path_source_mode, resolve_fps

ENERGY_LINE = "window string, energy string, source string, mode string, _bad string"
CODE_LINE = "window bigint, codes array<int>"
SEGMENT_DOC = (
    "video string, segments array<struct<start_sec:double,end_sec:double,label:string>>, video_duration_sec double, fps double, orig_fps double, processed_at string, "
    "segmentation_params struct<threshold:double,mode:string,hysteresis_ratio:double,up_count:int,down_count:int,cooldown_windows:int,min_len_windows:int,stride:int,target_fps:double,orig_fps:double>"
)
SIDECAR = (
    "codes_windows array<array<int>>, quantized_windows array<array<array<float>>>, selected_win_idxs array<int>, overlap_ratio_threshold double, "
    "segment struct<start_frame:int,end_frame:int,start_win:int>, window struct<T:int,stride:int,target_fps:int>, align string, video_segment_path string, source string, allow_overlap boolean"
)


def energy_files(spark: SparkSession, root: str, glob: str = "*stream_energy_*.jsonl") -> DataFrame:
    """``path, line_id, win_idx, energy, source, mode`` of all energy files below a folder.

    Blank lines and lines that are no JSON are skipped; numbers may be written as text; lines without window or energy
    are dropped. ``line_id`` rises within a file.
    """
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    t = t.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_id"), "value").where(F.trim("value") != "")
    j = F.from_json("value", ENERGY_LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    t = t.withColumn("j", j).where(F.col("j._bad").isNull())
    at = path_source_mode(F.col("path"))
    return t.select(
        "path", "line_id", F.col("j.window").try_cast("double").cast("bigint").alias("win_idx"), F.col("j.energy").try_cast("double").alias("energy"), F.coalesce("j.source", at["source"]).alias("source"), F.coalesce("j.mode", at["mode"]).alias("mode")
    ).where("win_idx is not null and energy is not null")


def code_files(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).schema(CODE_LINE).json(root)
    return t.select(F.col("_metadata.file_path").alias("path"), "window", "codes").where("window is not null")


def segment_documents(spark: SparkSession, root: str) -> DataFrame:
    """One row per readable document; fps from whichever place holds it; ``segments`` that are no list are null."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*segments*.json").option("multiLine", "true").schema(SEGMENT_DOC).json(root)
    kind = F.when(F.col("path").contains("pred"), "pred").when(F.col("path").rlike(r"_noisy\.json$"), "gt_noisy").otherwise("gt")
    t = t.select(F.col("_metadata.file_path").alias("path"), "*").where("video is not null")
    return t.withColumn("doc_kind", kind).withColumn("fps", resolve_fps(F.col("orig_fps"), F.col("fps"), F.col("segmentation_params.orig_fps"))).drop("orig_fps")


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.codes.json").option("multiLine", "true").schema(SIDECAR).json(root)
    return t.select(F.col("_metadata.file_path").alias("path"), "*")


def listing(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """``path, length`` of the files with one of the extensions (any case), without reading them."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    ends = F.lit(False)
    for x in extensions:
        ends = ends | F.lower("path").endswith(x.lower())
    return t.where(ends)


def by_priority(files: DataFrame, wanted: list[str]) -> DataFrame:
    """One file per folder: the first of ``wanted`` that its path contains, else the first by name."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    rank = F.lit(len(wanted))
    for i, w in reversed(list(enumerate(wanted))):
        rank = F.when(F.col("path").contains(w), i).otherwise(rank)
    return files.groupBy(folder.alias("folder")).agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


def paired(files: DataFrame, videos: DataFrame, root: str) -> DataFrame:
    """The video of every data file: same folder and stem, else the same relative path below ``root``, else the same stem."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(\.codes)?\.[^.]*$", "")
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]+$", 1)
    f = files.select("path").withColumn("stem", stem("path"))
    v = videos.select(F.col("path").alias("video")).withColumn("stem", stem("video"))
    rel = F.regexp_replace(folder("path"), "^.*?/", "")
    rank = F.when(folder("path") == folder("video"), 0).when(F.concat(F.lit(root + "/"), rel) == folder("video"), 1).otherwise(2)
    j = f.join(v, "stem", "left").withColumn("rank", rank)
    return j.groupBy("path").agg(F.min_by("video", F.struct("rank", "video")).alias("video"))
