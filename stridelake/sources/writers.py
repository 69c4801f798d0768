"""Sinks: segment documents, sidecars, reports, and incremental writes that skip what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_documents(segments: DataFrame) -> DataFrame:
    """``path, json``: one document per series, segments in order, labels segment_0, segment_1, ..."""
    rows = F.sort_array(F.collect_list(F.struct("start_sec", "end_sec")))
    g = segments.groupBy("path").agg(rows.alias("r"))
    doc = F.struct(
        F.col("path").alias("video"),
        F.transform("r", lambda x, i: F.struct(F.round(x["start_sec"], 6).alias("start_sec"), F.round(x["end_sec"], 6).alias("end_sec"), F.concat(F.lit("segment_"), i.cast("string")).alias("label"))).alias("segments"),
    )
    return g.select("path", F.to_json(doc).alias("json"))


def write_jsonl(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "append") -> None:
    """One JSON object per line; partitions become folders."""
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    (w.partitionBy(*partition) if partition else w).json(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    w = df.write.mode("overwrite")
    w.option("header", "true").csv(path) if fmt == "csv" else w.json(path)


def pending(wanted: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """What is wanted and not there yet."""
    return wanted.join(present.select(*key).distinct(), key, "left_anti")


def write_missing(wanted: DataFrame, path: str, key: list[str]) -> int:
    """Append only rows whose key the target does not hold; the number of rows written. A target that does not exist is empty."""
    spark = wanted.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    rows = pending(wanted, spark.read.parquet(path), key) if there else wanted
    rows = rows.dropDuplicates(key)
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n
