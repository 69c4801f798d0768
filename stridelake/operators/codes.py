"""Code sequences: usage statistics, bags of codes, TF-IDF and hashed bigrams. Rows: seg, pos, code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequencies(codes: DataFrame) -> DataFrame:
    return codes.where("code is not null").groupBy("code").agg(F.count("*").alias("n"))


def frequency_report(codes: DataFrame, top: int = 10) -> DataFrame:
    """One row: totals, distinct codes, extremes, spread of the frequencies, the most and least frequent codes (ties by code)."""
    f = frequencies(codes)
    a = f.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.min("code").alias("min_code"), F.max("code").alias("max_code"), F.avg("n").alias("mean_n"), F.stddev_pop("n").alias("std_n"))
    most = f.orderBy(F.desc("n"), "code").limit(top).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "code"))).alias("m"))
    least = f.orderBy("n", "code").limit(top).agg(F.sort_array(F.collect_list(F.struct("n", "code"))).alias("l"))
    return a.crossJoin(most).crossJoin(least).select("total", "distinct", "min_code", "max_code", "mean_n", "std_n", F.col("m.code").alias("most"), F.col("l.code").alias("least"))  # one row each


def perplexity(codes: DataFrame, size: int) -> DataFrame:
    """2 to the entropy (bits, with 1e-10 inside the logarithm), also relative to min(size, number of codes)."""
    f = frequencies(codes)
    total = f.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    a = f.crossJoin(F.broadcast(total)).agg(F.pow(F.lit(2.0), -F.sum(p * F.log2(p + 1e-10))).alias("perplexity"), F.max("t").alias("t"))  # one row
    return a.select("perplexity", (F.col("perplexity") / F.least(F.lit(size).cast("long"), F.col("t"))).alias("normalised"))


def entropy(codes: DataFrame, size: int) -> DataFrame:
    """Entropy in nats, divided by ln(max(effective size, 2)), distinct codes and perplexity."""
    f = frequencies(codes)
    total = f.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    a = f.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log(p))).alias("entropy"), F.count("*").alias("unique"), F.max("code").alias("top"))  # one row
    eff = F.greatest(F.col("top") + 1, F.lit(size), F.lit(1))
    return a.select("entropy", (F.col("entropy") / F.log(F.greatest(eff, F.lit(2)).cast("double"))).alias("normalised"), "unique", F.exp("entropy").alias("perplexity"))


def dead_codes(codes: DataFrame, size: int) -> DataFrame:
    """Codes of 0 .. size-1 that never occur."""
    every = codes.sparkSession.range(size).select(F.col("id").alias("code"))
    return every.join(codes.select(F.col("code").cast("long").alias("code")).distinct(), "code", "left_anti")


def clipped(c: Column, size: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), c)).cast("long")


def bag(codes: DataFrame, size: int = 2048) -> DataFrame:
    """Share of each code in its segment, codes outside the book clipped to its ends: ``seg, code, n, share``."""
    g = codes.where("code is not null").groupBy("seg", clipped(F.col("code"), size).alias("code")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy("seg")) + 1e-8))


def tfidf(codes: DataFrame, size: int = 2048) -> DataFrame:
    """Smooth inverse document frequency ln((1 + N) / (1 + df)) + 1, rows of unit length: ``seg, code, w``."""
    b = bag(codes, size)
    n = b.select("seg").distinct().agg(F.count("*").alias("n_seg"))
    df = b.groupBy("code").agg(F.count("*").alias("df"))
    w = b.join(df, "code").crossJoin(F.broadcast(n)).withColumn("w", F.col("n") * (F.log((1 + F.col("n_seg")) / (1 + F.col("df"))) + 1))  # one row
    return w.select("seg", "code", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("seg")))).alias("w"))


def bigram_hash(codes: DataFrame, dim: int = 16384, a: int = 1315423911, b: int = 2654435761) -> DataFrame:
    """Share of hashed pairs of neighbouring codes: ``seg, bucket, n, share``; ``a`` and ``b`` are the fixed multipliers."""
    w = Window.partitionBy("seg").orderBy("pos")
    p = codes.withColumn("next", F.lead("code").over(w)).where("code is not null and next is not null")
    h = F.pmod(F.lit(a) * F.col("code").cast("long") + F.lit(b) * F.col("next").cast("long"), F.lit(dim))
    g = p.groupBy("seg", h.alias("bucket")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy("seg")) + 1e-8))


def positional_zip(segments: DataFrame) -> DataFrame:
    """``seg_id, win, k, code, vec`` of windows whose codes and vectors have the same number."""
    t = segments.select("seg_id", F.posexplode(F.arrays_zip(F.col("codes_windows").alias("c"), F.col("quantized_windows").alias("v"))).alias("i", "z")).where("size(z.c) = size(z.v)")
    return t.select("seg_id", F.col("i").cast("long").alias("win"), F.posexplode(F.arrays_zip(F.col("z.c").alias("code"), F.col("z.v").alias("vec"))).alias("k", "y")).select("seg_id", "win", F.col("k").cast("long").alias("k"), "y.code", "y.vec")


def codes_by_cluster(codes: DataFrame, clusters: DataFrame) -> DataFrame:
    """How often each code occurs in each cluster."""
    return codes.join(clusters, "seg").groupBy("label", "code").agg(F.count("*").alias("n"))


def expected_log2(size: int) -> float:
    return math.log2(size)
