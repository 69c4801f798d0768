"""Vectors: pooling, scaling, distances, cluster scores and their inputs.

Sums of vectors are formed by NumPy where the rows are read, one partial sum per group and task, so centroids need no
explode and no large shuffle. Scores that have a closed form in these sums (mean pairwise cosine, Davies-Bouldin's
centroid part, Calinski-Harabasz) use it. What needs all pairs by definition (silhouette, pairwise Euclidean distance)
runs over pairs of blocks with one matrix product each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions.scalars import norm

# --- token energies and pooling of the vectors of one segment (array<array<double>>) -------------------------------------


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x)


def l2_mean(tokens: Column) -> Column:
    return _mean(F.transform(tokens, norm))


def token_diff_l2_mean(tokens: Column) -> Column:
    """Mean step length between neighbouring tokens; one token alone gives its length."""
    n = F.size(tokens)
    steps = F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n), lambda a, b: norm(F.zip_with(a, b, lambda p, q: q - p)))
    return F.when(n < 2, l2_mean(tokens)).otherwise(_mean(steps))


def window_energy(source: Column, mode: Column, tokens: Column, speeds: Column) -> Column:
    """Dispatch: velocity ignores the mode, an unknown mode is l2_mean, missing input gives null."""
    return F.when(source == "velocity", _mean(speeds)).when(mode == "token_diff_l2_mean", token_diff_l2_mean(tokens)).otherwise(l2_mean(tokens))


def gated(energy: Column, pre_gate: Column, motion_gate: Column, source: Column) -> Column:
    """Energy of a gated window is 0; the motion gate leaves velocity as it is."""
    return F.when(pre_gate | (motion_gate & (source != "velocity")), 0.0).otherwise(energy)


def _by_dim(tokens: Column, f: Callable[[Column], Column]) -> Column:
    """f over the values of each dimension."""
    dims = F.sequence(F.lit(0), F.size(tokens[0]) - 1)
    return F.transform(dims, lambda d: f(F.transform(tokens, lambda v: F.get(v, d))))


def pool_mean(tokens: Column) -> Column:
    return _by_dim(tokens, _mean)


def pool_max(tokens: Column) -> Column:
    return _by_dim(tokens, F.array_max)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value worked out once, however often f uses it, also within lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def pool_mean_std(tokens: Column) -> Column:
    def sd(x: Column) -> Column:
        return _let(_mean(x), lambda m: F.sqrt(_mean(F.transform(x, lambda v: (v - m) * (v - m)))))

    return F.concat(pool_mean(tokens), _by_dim(tokens, sd))


def pool_first_last(tokens: Column) -> Column:
    return F.concat(F.element_at(tokens, 1), F.element_at(tokens, -1))


def _weighted(tokens: Column, weights: Column) -> Column:
    """Sum of the tokens times their weights, token by token."""
    zero = F.transform(tokens[0], lambda _: F.lit(0.0))
    return F.aggregate(F.zip_with(tokens, weights, lambda x, w: F.transform(x, lambda v: v * w)), zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))


def pool_attn_norm(tokens: Column) -> Column:
    """Mean weighted by the vectors' lengths; the plain mean if all are about 0."""

    def pool(n: Column) -> Column:
        return _let(_sum(n), lambda total: F.when(total < 1e-12, pool_mean(tokens)).otherwise(_weighted(tokens, F.transform(n, lambda w: w / (total + 1e-8)))))

    return _let(F.transform(tokens, norm), pool)


def pool_unit_norm(tokens: Column) -> Column:
    """Unit vectors weighted by their vectors' share of the length, brought to unit length."""

    def pool(n: Column) -> Column:
        w = _let(_sum(n), lambda total: F.transform(n, lambda x: F.lit(1.0) / total))  # length / total times 1 / length
        return _let(_weighted(tokens, w), lambda p: _let(norm(p), lambda z: F.transform(p, lambda x: x / (z + 1e-9))))

    return _let(F.transform(tokens, lambda t: norm(t) + 1e-9), pool)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


POOLS = {"mean": pool_mean, "max": pool_max, "mean_std": pool_mean_std, "first_last": pool_first_last, "attn_norm": pool_attn_norm}


def to_series(tokens: Column, how: str = "norm") -> Column:
    """One number per step."""
    return F.transform(tokens, norm if how == "norm" else _mean)


# --- sums by group -----------------------------------------------------------------------------------------------------------


def _matrix(a: pa.Array) -> np.ndarray:
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    v = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return v.reshape(len(a), -1) if len(a) else np.zeros((0, 0))


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, x) -> label, n, s (sum), q (sum of squares): one row per label and task."""
    acc: dict = {}
    for b in batches:
        if not b.num_rows:
            continue
        labels, x = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1))
        for u in np.unique(labels).tolist():
            m = x[labels == u]
            n, s, q = acc.get(u, (0, 0.0, 0.0))
            acc[u] = (n + len(m), s + m.sum(0), q + (m * m).sum(0))
    if acc:
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(acc), pa.int64()), pa.array([a[0] for a in acc.values()], pa.int64()), pa.array([a[1].tolist() for a in acc.values()], kind), pa.array([a[2].tolist() for a in acc.values()], kind)], ["label", "n", "s", "q"]
        )


def group_sums(vectors: DataFrame, label: Column, x: str = "x") -> DataFrame:
    """``label, n, s, q``: number, sum and sum of squares of the vectors of every label."""
    part = vectors.select(label.cast("long").alias("label"), F.col(x).cast("array<double>").alias("x")).where("label is not null and x is not null").mapInArrow(_partial_sums, "label long, n long, s array<double>, q array<double>")

    def add(batches):
        acc: dict = {}
        for b in batches:
            if b.num_rows:
                n, s, q = b.column(1).to_numpy(), _matrix(b.column(2)), _matrix(b.column(3))
                for i, u in enumerate(b.column(0).to_pylist()):
                    m, t, r = acc.get(u, (0, 0.0, 0.0))
                    acc[u] = (m + n[i], t + s[i], r + q[i])
        if acc:
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(acc), pa.int64()), pa.array([a[0] for a in acc.values()], pa.int64()), pa.array([a[1].tolist() for a in acc.values()], kind), pa.array([a[2].tolist() for a in acc.values()], kind)], ["label", "n", "s", "q"]
            )

    return part.repartition("label").mapInArrow(add, part.schema)


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    g = group_sums(vectors, F.col(label))
    return g.select("label", "n", F.transform("s", lambda v: v / F.col("n")).alias("c"))


def column_stats(vectors: DataFrame) -> DataFrame:
    """One row: n, mean and population deviation of every dimension."""
    g = group_sums(vectors, F.lit(0))
    mean = F.transform("s", lambda v: v / F.col("n"))
    sd = F.zip_with("q", mean, lambda q, m: F.sqrt(F.greatest(F.lit(0.0), q / F.col("n") - m * m)))
    return g.select("n", mean.alias("mean"), sd.alias("sd"))


def standardise(vectors: DataFrame) -> DataFrame:
    """Columns to mean 0 and population deviation 1; constant ones only centred."""
    st = column_stats(vectors)
    z = F.zip_with(F.zip_with(F.col("x"), F.col("mean"), lambda a, m: a - m), F.col("sd"), lambda a, s: a / F.when(s < 1e-9, 1.0).otherwise(s))
    return vectors.crossJoin(F.broadcast(st.select("mean", "sd"))).withColumn("x", z).drop("mean", "sd")  # one row


# --- pairs in blocks --------------------------------------------------------------------------------------------------------------


def block_pairs(a: DataFrame, f: Callable, schema: str, *, block_rows: int = 4096, ordered: bool = True) -> DataFrame:
    """f(ids, x, labels, ids2, x2, labels2) -> record batch, for every pair of blocks of ``a`` (id, x, label).

    Each row is sent to the pairs its block belongs to; a task holds two blocks. ``ordered``: each pair of blocks once.
    """
    n = a.count()
    blocks = max(1, -(-n // block_rows))
    r = a.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), F.col("label").cast("long").alias("label"))
    r = r.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    other = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    left = r.withColumn("o", F.explode(other)).withColumn("side", F.lit(0))
    right = r.withColumn("o", F.col("b")).withColumn("b2", F.explode(other)).withColumn("b", F.col("b2")).drop("b2").withColumn("side", F.lit(1))
    if ordered:
        left, right = left.where("b <= o"), right.where("b <= o")
    both = left.select("b", "o", "side", "id", "x", "label").unionByName(right.select("b", "o", "side", "id", "x", "label"))

    def run(key, t):
        side = t.column("side").to_numpy()
        parts = []
        for s in (0, 1):
            m = t.filter(pa.array(side == s))
            parts += [m.column("id").to_numpy(), _matrix(m.column("x")), m.column("label").to_numpy(zero_copy_only=False)]
        return f(key[0].as_py() == key[1].as_py(), *parts)

    return both.groupBy("b", "o").applyInArrow(run, schema)


def _distance(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        return 1 - np.clip(x @ y.T, -1, 1)
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)))


SLACK = 2e-8  # distances are ranked after rounding; what may be equal to the last one kept is kept too


def pair_distances(vectors: DataFrame, metric: str = "euclidean", *, each: int | None = None, top: int | None = None) -> DataFrame:
    """``i, j, dist`` for i < j: all pairs, whose number is quadratic by definition.

    ``each`` keeps of every two blocks only the pairs that are among the ``each`` nearest of one of their ends there,
    ``top`` only the ``top`` nearest pairs; the nearest of all are among them, and the rest is never written.
    """

    def f(same, i1, x1, l1, i2, x2, l2):
        d = _distance(x1, x2, metric) if len(i1) and len(i2) else np.zeros((len(i1), len(i2)))
        keep = np.ones(d.shape, bool)
        if d.size and each is not None:
            own = np.where(i1[:, None] == i2[None, :], np.inf, d)
            keep = np.zeros(d.shape, bool)
            for axis in (0, 1):
                k = min(each, d.shape[axis]) - 1
                keep |= d <= np.take(np.partition(own, k, axis=axis), [k], axis=axis) + SLACK
        if same:
            keep &= i1[:, None] < i2[None, :]
        if top is not None and keep.sum() > top:
            keep &= d <= np.partition(d[keep], top - 1)[top - 1] + SLACK
        a, b = np.nonzero(keep)
        lo, hi = np.minimum(i1[a], i2[b]), np.maximum(i1[a], i2[b])
        return pa.table({"i": lo.astype(np.int64), "j": hi.astype(np.int64), "dist": d[a, b]})

    return block_pairs(vectors, f, "i long, j long, dist double")


def distance_sums(vectors: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``id, label, other, s``: the sum of distances of every vector to the vectors of each label."""

    def f(same, i1, x1, l1, i2, x2, l2):
        ids, labels, others, sums = [], [], [], []
        if len(i1) and len(i2):
            d = _distance(x1, x2, metric)
            if same:
                d[i1[:, None] == i2[None, :]] = 0
            for u in np.unique(l2):
                ids.append(i1), labels.append(l1), others.append(np.full(len(i1), u)), sums.append(d[:, l2 == u].sum(1))
        cat = lambda z, t: np.concatenate(z).astype(t) if z else np.zeros(0, t)
        return pa.table({"id": cat(ids, np.int64), "label": cat(labels, np.int64), "other": cat(others, np.int64), "s": cat(sums, np.float64)})

    out = block_pairs(vectors, f, "id long, label long, other long, s double", ordered=False)
    return out.groupBy("id", "label", "other").agg(F.sum("s").alias("s"))


def silhouette(vectors: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``id, label, s``: exact silhouette of every vector; alone in its cluster it is 0."""
    n = vectors.groupBy(F.col("label").cast("long").alias("other")).agg(F.count("*").alias("n"))
    d = distance_sums(vectors, metric).join(n, "other")
    own = F.col("label") == F.col("other")
    g = d.groupBy("id", "label").agg(F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own, F.try_divide(F.col("s"), F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    s = F.when((F.col("n") == 1) | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return g.select("id", "label", s.alias("s"))


# --- scores -------------------------------------------------------------------------------------------------------------------------


def davies_bouldin(vectors: DataFrame) -> DataFrame:
    c = centroids(vectors)
    d = vectors.join(c.select("label", "c"), "label")
    spread = d.groupBy("label").agg(F.avg(F.sqrt(F.aggregate(F.zip_with("x", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))).alias("s"))
    c = c.join(spread, "label")
    o = c.select(F.col("label").alias("l2"), F.col("c").alias("c2"), F.col("s").alias("s2"))
    r = c.join(o, F.col("label") != F.col("l2"))  # pairs of clusters
    r = r.withColumn("r", (F.col("s") + F.col("s2")) / F.sqrt(F.aggregate(F.zip_with("c", "c2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)))
    return r.groupBy("label").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(vectors: DataFrame) -> DataFrame:
    """From group sums alone: within = sum of squares minus squared sums over n, between from the centroids."""
    g = group_sums(vectors, F.col("label"))
    sq = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b * b)
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    t = group_sums(vectors, F.lit(0)).select(F.col("n").alias("nt"), F.col("s").alias("st"))
    a = g.agg(F.sum(add(F.col("q")) - sq(F.col("s")) / F.col("n")).alias("within"), F.sum(sq(F.col("s")) / F.col("n")).alias("means"), F.count("*").alias("k"))
    x = a.crossJoin(t)  # one row each
    between = F.col("means") - sq(F.col("st")) / F.col("nt")
    return x.select((between / (F.col("k") - 1) / (F.col("within") / (F.col("nt") - F.col("k")))).alias("calinski_harabasz"))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("x", _unit(F.col("x")))


def _unit(x: Column) -> Column:
    return _let(F.greatest(norm(x), F.lit(1e-12)), lambda n: F.transform(x, lambda v: v / n))


def mean_cosine(vectors: DataFrame) -> DataFrame:
    """``label, n, mean_cosine`` over all pairs of each label: (|sum of unit vectors|^2 - n) / (n (n - 1)), no pairs formed."""
    g = group_sums(unit_vectors(vectors), F.col("label"))
    s2 = F.aggregate("s", F.lit(0.0), lambda a, b: a + b * b)
    return g.select("label", "n", F.try_divide(s2 - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("mean_cosine"))


def intra_inter_cosine(vectors: DataFrame, singleton: float | None = 0.0) -> DataFrame:
    """Mean within-cluster and centroid cosine distances and their ratio; clusters of one count as ``singleton`` or not at all."""
    m = mean_cosine(vectors)
    intra = m.agg(F.coalesce(F.avg(F.when(F.col("n") > 1, 1 - F.col("mean_cosine"))), F.lit(singleton)).alias("intra"))
    c = group_sums(unit_vectors(vectors), F.col("label")).select("label", _unit(F.col("s")).alias("x"))
    t = group_sums(c, F.lit(0)).select("n", F.aggregate("s", F.lit(0.0), lambda a, b: a + b * b).alias("s2"))
    inter = t.select(F.try_divide(F.col("n") * (F.col("n") - 1) - (F.col("s2") - F.col("n")), F.col("n") * (F.col("n") - 1)).alias("inter"))
    return intra.crossJoin(inter).withColumn("ratio", F.col("intra") / (F.col("inter") + 1e-8))  # one row each


def matrix_intra_inter(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """From a distance list: mean over clusters of the mean inner distance, mean over cluster pairs of the mean cross distance."""
    a, b = labels.select(F.col("id").alias("i"), F.col("label").alias("li")), labels.select(F.col("id").alias("j"), F.col("label").alias("lj"))
    p = pairs.join(a, "i").join(b, "j").groupBy(F.least("li", "lj").alias("p"), F.greatest("li", "lj").alias("q")).agg(F.avg("dist").alias("m"))
    return p.agg(F.avg(F.when(F.col("p") == F.col("q"), F.col("m"))).alias("intra"), F.avg(F.when(F.col("p") != F.col("q"), F.col("m"))).alias("inter"))


def kmeans_sweep(vectors: DataFrame, ks: list[int], seed: int = 42) -> DataFrame:
    """``k, silhouette, cost`` of k-means for every k (fewer than three vectors: none)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    v = vectors.select("id", array_to_vector("x").alias("features")).persist()
    n = v.count()
    out = []
    for k in sorted({k for k in ks if 2 <= k < n}) if n >= 3 else []:
        model = KMeans(k=k, seed=seed, initSteps=5).fit(v)
        out.append((k, float(ClusteringEvaluator(metricName="silhouette").evaluate(model.transform(v))), float(model.summary.trainingCost)))
    v.unpersist()
    return spark.createDataFrame(out, "k int, silhouette double, cost double")


def pick_model(scores: DataFrame, within: float = 0.005) -> DataFrame:
    """Best silhouette; within ``within`` of it the smallest ratio, then the smaller model. NaN scores never win.

    ``scores``: model, silhouette, ratio, size.
    """
    s = scores.where(F.col("silhouette").isNotNull() & ~F.isnan("silhouette"))
    top = s.agg(F.max("silhouette").alias("top"))
    return s.crossJoin(top).where(F.col("silhouette") >= F.col("top") - within).orderBy("ratio", "size", "model").limit(1).drop("top")  # one row


def pca(vectors: DataFrame, k: int) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select("id", "label", array_to_vector("x").alias("features"))
    return PCA(k=k, inputCol="features", outputCol="p").fit(v).transform(v).select("id", "label", vector_to_array("p").alias("p"))


def dtw(x: list[float], y: list[float]) -> float:
    """Exact dynamic time warping with absolute differences; one row of the table is held."""
    y_ = np.asarray(y)
    prev = np.full(len(y_) + 1, np.inf)
    prev[0] = 0.0
    for a in x:
        cost = np.abs(a - y_)
        cur = np.empty_like(prev)
        cur[0] = np.inf
        best = np.minimum(prev[1:], prev[:-1])
        for j in range(len(y_)):
            cur[j + 1] = cost[j] + min(best[j], cur[j])
        prev = cur
    return float(prev[-1])


def dtw_pairs(pairs: DataFrame) -> DataFrame:
    """``i, j, dist`` for rows of i, j, a, b (two series as arrays)."""

    def run(batches):
        for b in batches:
            d = [dtw(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.float64())], ["i", "j", "dist"])

    return pairs.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("a").cast("array<double>").alias("a"), F.col("b").cast("array<double>").alias("b")).mapInArrow(run, "i long, j long, dist double")


def average_linkage(pairs: DataFrame, k: int, max_items: int = 3000) -> DataFrame:
    """``id, label`` of k clusters by average linkage on a full distance list of at most ``max_items`` items."""
    n = pairs.select(F.explode(F.array("i", "j")).alias("i")).distinct().count()
    if n > max_items:
        raise ValueError(f"{n} items: a full distance matrix is meant for at most {max_items}; use the clustering of sparse graphs")

    def run(key, t):
        i, j, d = t.column("i").to_numpy(), t.column("j").to_numpy(), t.column("dist").to_numpy()
        ids = np.unique(np.concatenate([i, j]))
        m = np.full((len(ids), len(ids)), np.inf)
        a, b = np.searchsorted(ids, i), np.searchsorted(ids, j)
        m[a, b] = m[b, a] = d
        size, label, left = np.ones(len(ids)), np.arange(len(ids)), len(ids)
        while left > k:
            p, q = np.unravel_index(int(m.argmin()), m.shape)
            p, q = min(p, q), max(p, q)
            row = (m[p] * size[p] + m[q] * size[q]) / (size[p] + size[q])
            m[p], m[:, p] = row, row
            m[p, p] = m[q, :] = m[:, q] = np.inf
            size[p] += size[q]
            label[label == q] = p
            left -= 1
        _, lab = np.unique(label, return_inverse=True)
        return pa.table({"id": ids.astype(np.int64), "label": lab.astype(np.int64)})

    return pairs.groupBy(F.lit(0).alias("g")).applyInArrow(run, "id long, label long")


def nearest_reference(points: DataFrame, refs: DataFrame) -> DataFrame:
    """The nearest point of each reference point: ``ref, id``. ``refs`` is a stated query set (checked to be small)."""
    n = refs.count()
    if n > 10_000:
        raise ValueError(f"{n} reference points, at most 10000")
    d = F.pow(F.col("row") - F.col("rrow"), 2) + F.pow(F.col("col") - F.col("rcol"), 2)
    return points.crossJoin(F.broadcast(refs)).groupBy("ref").agg(F.min_by("id", F.struct(d, "id")).alias("id"))


def top_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    return pairs.orderBy(F.desc("sim"), F.desc("i"), F.desc("j")).limit(k)


def knn_of(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of every item from a distance list."""
    both = pairs.select("i", "j", "dist").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("dist", "j"))).where(F.col("r") <= k)
