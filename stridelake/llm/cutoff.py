"""Score cutoff per source that keeps a target fraction of the source's records.

Method: a cutting-plane order statistic. The k-th largest score of a source minimises the convex pinball loss

    f(t) = sum(max(0, (1-q)(t-x)) + max(0, q(x-t)))

whose value and subgradient at any t follow from four numbers: how many scores lie on either side of t and their sums.
A pass over the data evaluates, for every source at once, the loss at a handful of probes; the tangents at the two
probes that enclose the minimum are cut with each other, the crossing and points around it are the next probes. Each
pass also returns the largest score below and the smallest score at or above every probe, so once only one candidate is
left the cutoff snaps to that very score. No sort, no shuffle of rows: a pass ships (probes + 1) small rows per source.

Defined results: scores that are null, NaN, infinite or negative do not count; equal scores are kept or dropped together;
a source without counted records or with a null target gets no cutoff; a target of 0 or less keeps nothing, one of 100
or more keeps everything; the cutoff is the largest score whose records at or above it make up at least the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES = 24
MAX_SOURCES = 2000  # targets handled by one run of passes; more are worked off in groups of this size
MAX_PASSES = 200


def _counted(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (score >= 0) & (score < float("inf"))


def _probes(lo: float, hi: float, cut: float | None) -> list[float]:
    """Probes strictly above lo and at most hi: around the tangents' crossing, evenly spaced and in equal ratios."""
    out = {hi}
    if cut is not None and lo < cut <= hi:
        out.add(cut)
        for k in range(1, 5):
            out |= {cut - (cut - lo) * 8.0**-k, cut + (hi - cut) * 8.0**-k}
    n = PROBES // 3
    out |= {lo + (hi - lo) * i / n for i in range(1, n)}
    if lo >= 0 and hi > 0:
        a, b = math.log(max(lo, hi * 1e-12)), math.log(hi)
        out |= {math.exp(a + (b - a) * i / n) for i in range(1, n)}
    return sorted(p for p in out if lo < p <= hi)


class _Source:
    """The bracket of one source: c is at least ``lo`` (a score) and less than ``hi`` or the score ``top`` below it."""

    def __init__(self, n: int, low: float, high: float, total: float, pct: float):
        self.n, self.total = n, total
        self.k = min(n, max(1, math.ceil(n * pct / 100 - 1e-9)))
        self.lo, self.top = low, high
        self.below = {low: (0, 0.0)}  # probe -> count and sum of the scores below it
        self.cutoff = low if self.k == n or low == high else None
        self.cut = None

    def probes(self) -> list[float]:
        return _probes(self.lo, self.top, self.cut)

    def loss(self, t: float) -> tuple[float, float]:
        """Pinball loss and a subgradient at t; the minimum is the k-th largest score."""
        c, s = self.below[t]
        q = 1 - self.k / self.n + 0.5 / self.n
        up, su = self.n - c, self.total - s
        return (1 - q) * (t * c - s) + q * (su - t * up), (1 - q) * c - q * up

    def learn(self, ps: list[float], cells: dict[int, tuple[int, float, float, float]]) -> None:
        """cells: by the number of probes at or below a score: count, sum, smallest and largest of the scores there."""
        c, s = 0, 0.0
        least, most = [math.inf] * (len(ps) + 2), [-math.inf] * (len(ps) + 2)
        for i in range(len(ps), -1, -1):
            least[i] = min(least[i + 1], cells[i][2]) if i in cells else least[i + 1]
        for i in range(len(ps) + 1):
            most[i + 1] = max(most[i], cells[i][3]) if i in cells else most[i]
        lo, top, before, after = self.lo, self.top, self.lo_probe(), None
        for i, p in enumerate(ps):
            if i in cells:
                c, s = c + cells[i][0], s + cells[i][1]
            self.below[p] = (c, s)
            if self.n - c >= self.k:  # enough scores at or above p
                lo, before = max(lo, least[i + 1]), p
            else:
                top, after = min(top, most[i + 1]), p
                break
        self.lo, self.top = lo, top
        if lo >= top:
            self.cutoff = lo
        if after is None:
            after = ps[-1]
        self._low = before
        self.cut = None
        if before in self.below and after in self.below and before < after:
            (f0, g0), (f1, g1) = self.loss(before), self.loss(after)
            if g1 > g0:
                self.cut = (f0 - f1 + after * g1 - before * g0) / (g1 - g0)
        self.below = {x: v for x, v in self.below.items() if x in (before, after)}

    _low: float | None = None

    def lo_probe(self) -> float:
        return self._low if self._low is not None and self._low in self.below else next(iter(self.below))


def _passes(rows: DataFrame, sources: dict[str, _Source]) -> int:
    """Narrow every bracket until its cutoff is one score; the number of passes made."""
    made = 0
    while open_ := {name: x for name, x in sources.items() if x.cutoff is None}:
        made += 1
        if made > MAX_PASSES:
            raise RuntimeError(f"no cutoff after {MAX_PASSES} passes: {list(open_)[:3]}")
        probes = {name: x.probes() for name, x in open_.items()}
        table = F.create_map(*[v for name, ps in probes.items() for v in (F.lit(name), F.array(*map(F.lit, ps)))])
        at = F.size(F.filter(table[F.col("source")], lambda p: p <= F.col("x"))) if len(open_) > 8 else None
        if at is None:  # plain comparisons stay in generated code
            at = F.lit(0)
            for name, ps in probes.items():
                at = F.when(F.col("source") == name, sum((F.col("x") >= p).cast("int") for p in ps)).otherwise(at)
        got = (
            rows.where(F.col("source").isin(list(open_)))
            .groupBy("source", at.alias("cell"))
            .agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .collect()  # at most (probes + 1) rows a source
        )
        cells: dict[str, dict] = {name: {} for name in open_}
        for r in got:
            cells[r["source"]][r["cell"]] = (r["n"], r["s"], r["lo"], r["hi"])
        for name, x in open_.items():
            x.learn(probes[name], cells[name])
    return made


def score_cutoffs(df: DataFrame, source: Column, score: Column, targets: dict[str, float]) -> dict[str, tuple[float, int, int]]:
    """For each source of ``targets`` (percent to keep): cutoff, records kept, records counted.

    The result and every pass hold a few rows per target; the records themselves are never moved.
    """
    rows = df.select(source.alias("source"), score.cast("double").alias("x")).where(F.col("source").isNotNull() & _counted(F.col("x")))
    out: dict[str, tuple[float, int, int]] = {}
    names = [s for s, pct in targets.items() if s is not None and pct is not None and pct > 0]
    for i in range(0, len(names), MAX_SOURCES):
        group = names[i : i + MAX_SOURCES]
        mine = rows.where(F.col("source").isin(group)).persist()
        first = mine.groupBy("source").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("x").alias("s")).collect()
        sources = {r["source"]: _Source(r["n"], r["lo"], r["hi"], r["s"], targets[r["source"]]) for r in first}
        _passes(mine, sources)
        if sources:
            kept = (
                mine.groupBy("source").agg(*[F.sum(((F.col("source") == n) & (F.col("x") >= x.cutoff)).cast("long")).alias(f"k{j}") for j, (n, x) in enumerate(sources.items())]).collect()
                if len(sources) <= 8
                else mine.where(F.col("x") >= F.create_map(*[F.lit(v) for n, x in sources.items() for v in (n, x.cutoff)])[F.col("source")]).groupBy("source").count().collect()
            )
            size = {r[0]: max(r[1:]) for r in kept}
            out |= {n: (x.cutoff, size.get(n, 0), x.n) for n, x in sources.items()}
        mine.unpersist()
    return out


def keep_fraction(df: DataFrame, source: Column, score: Column, targets: dict[str, float]) -> DataFrame:
    """The records of ``df`` whose score reaches their source's cutoff, with all their columns."""
    found = score_cutoffs(df, source, score, targets)
    x = score.cast("double")
    keep = F.lit(False)
    if 0 < len(found) <= 64:
        for name, (cutoff, _, _) in found.items():
            keep = F.when(source == name, x >= cutoff).otherwise(keep)
    elif found:
        keep = x >= F.create_map(*[F.lit(v) for name, f in found.items() for v in (name, f[0])])[source]
    return df.where(_counted(x) & F.coalesce(keep, F.lit(False)))


def cutoff_report(df: DataFrame, source: Column, score: Column, targets: dict[str, float]) -> DataFrame:
    """``source, target_pct, cutoff, n_kept, n_counted``: one row for each target that has counted records."""
    found = score_cutoffs(df, source, score, targets)
    rows = [(n, float(targets[n]), c, k, m) for n, (c, k, m) in found.items()]
    return df.sparkSession.createDataFrame(rows, "source string, target_pct double, cutoff double, n_kept long, n_counted long")
