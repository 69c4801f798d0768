"""Samples, limits and resampling statistics: seeded, without ordering whole tables by a random number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on the keys and the seed only."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of every group, by hash order (window group limit keeps n rows per task before the shuffle)."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def subset(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def weighted(df: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, likelier with a larger weight (exponential keys: -ln(u) / weight, smallest first)."""
    k = -F.log(uniform(seed, key) + 1e-16) / F.greatest(F.col(weight), F.lit(1e-9))
    return df.orderBy(k, key).limit(n)


def with_replacement(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """About n draws with replacement: each row as often as a Poisson number of mean n / rows says, drawn by its key."""
    mean = n / max(1, df.count())
    term = acc = math.exp(-mean)
    upto = []
    for k in range(1, int(mean + 10 * math.sqrt(mean) + 12)):
        upto.append(acc)
        term *= mean / k
        acc += term
    times = F.size(F.filter(F.array(*map(F.lit, upto)), lambda c: c <= F.col("_u")))
    d = df.withColumn("_u", uniform(seed, key)).withColumn("_n", times).where("_n > 0")
    return d.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_u", "_n", "_k")


def shard(df: DataFrame, n: int, index: int, *keys: str) -> DataFrame:
    """One of n equal parts, the same for the same keys."""
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == index)


def random_pairs(df: DataFrame, group: str, key: str, cap: int, seed: int = 42) -> DataFrame:
    """Up to ``cap`` pairs (i, j) of each group: j = (i + r) mod n for a drawn offset r in 1 .. n-1."""
    p = Window.partitionBy(group)
    d = df.select(group, key).withColumn("i", F.row_number().over(p.orderBy(key)) - 1).withColumn("n", F.count("*").over(p)).where("n > 1")
    draws = F.sequence(F.lit(0), F.floor((F.lit(cap) - 1 - F.col("i")) / F.col("n")).cast("int"))
    d = d.where(F.col("i") < cap).withColumn("k", F.explode(draws))
    r = 1 + F.floor(uniform(seed, group, "i", "k") * (F.col("n") - 1)).cast("long")
    d = d.withColumn("j", F.pmod(F.col("i") + r, F.col("n")))
    names = df.select(group, F.col(key).alias("other")).withColumn("j", F.row_number().over(p.orderBy("other")) - 1)
    return d.join(names, [group, "j"]).select(group, F.col(key).alias("a"), F.col("other").alias("b"))


def bootstrap_mean(df: DataFrame, group: str, value: str, key: str, repeats: int = 200, level: float = 0.95, kind: str = "percentile", seed: int = 42) -> DataFrame:
    """Bootstrap interval of each group's mean. Rows get Poisson(1) counts per repeat, so no group is gathered.

    ``kind``: percentile, or basic (2 mean - quantile).
    """
    u = uniform(seed, key, "rep")
    e = 0.36787944117144233
    count, acc, term = F.lit(0), e, e
    for k in range(1, 9):
        count = F.when(u >= acc, k).otherwise(count)
        term /= k
        acc += term
    x = df.select(group, key, value).where(F.col(value).isNotNull()).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    m = x.withColumn("c", count).groupBy(group, "rep").agg(F.try_divide(F.sum(F.col("c") * F.col(value)), F.sum("c")).alias("m"))
    a = (1 - level) / 2
    q = m.groupBy(group).agg(F.percentile("m", [a, 1 - a]).alias("q"))
    j = df.groupBy(group).agg(F.avg(value).alias("mean")).join(q, group)
    lo, hi = (F.col("q")[0], F.col("q")[1]) if kind == "percentile" else (2 * F.col("mean") - F.col("q")[1], 2 * F.col("mean") - F.col("q")[0])
    return j.select(group, "mean", lo.alias("lo"), hi.alias("hi"))


def top_k(scores: DataFrame, key: str, k: int, p: float = 1.0) -> DataFrame:
    """The k best classes per key, or the smallest set whose probability exceeds p (the class that passes p is kept).

    ``scores``: key, cls, prob.
    """
    w = Window.partitionBy(key).orderBy(F.desc("prob"), "cls")
    before = F.coalesce(F.sum("prob").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return scores.withColumn("r", F.row_number().over(w)).withColumn("before", before).where((F.col("r") <= k) & (F.col("before") <= p)).drop("r", "before")
