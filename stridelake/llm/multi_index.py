"""Nearest vectors by an inverted multi-index.

Each vector is cut into two halves that are quantised apart, with K centroids each; a pair of centroids is a cell. A
query walks the cells in the order of its two summed centroid distances (the multi-sequence walk: a heap over the two
sorted distance lists) until the cells visited hold ``reach`` vectors, and the entries met are reranked by their exact
score.

On a cluster the cells are packed into bins of about ``bin_rows`` entries (cells of one first-half centroid, side by
side). A query is sent once to each bin it visits and scored there against the whole bin with one matrix product; every
product serves the entry's list of neighbours as well as the query's. Work per vector does not grow with the collection
as long as K may: K follows the square root of the number of vectors up to ``max_centroids``, so the table of occupied
cells, the only thing sent to all tasks beside the centroids, has at most ``max_centroids``^2 rows; beyond that the
cells get larger instead.

Reach. How far a walk has to go depends on how dense the vectors lie. ``probes`` vectors, chosen by a hash, are compared
with all vectors (one pass, linear in their number); for each region of first-half centroids the reach is the one at
which ``recall`` of the probes' true partners lie in bins that were visited, and ``reach`` at least.

Hot cells and bins. A cell is never cut and nothing in it is left out: a bin with many entries is scored in blocks of
entries, one with many visitors in shares of visitors, and every share meets every block, in different tasks; a task
holds one block of entries, its visitors stream past. Of copies of one vector only 2 * ``top`` are indexed (at most
``top`` of one ``seg``), which is enough for every list; the other copies take over the list of an indexed copy.

Fitting uses at most about ``sample`` vectors (chosen by a hash of their ids); every vector is indexed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm.vectors import pack, unpack
from stridelake.sources.tables import materialise, shuffle_partitions

BLOCK_ROWS = 16384  # entries of a bin that one task holds; rows of small bins scored together
VISIT_ROWS = 65536  # visitors of a bin that one task is meant to see
ROWS, COLS = 2048, 8192  # of a product of two blocks
PART_BYTES = 4 << 20  # rows of bins that make up a task's share
REGIONS = 16


@dataclass
class Quantiser:
    """Centroids of both halves."""

    halves: list[np.ndarray]

    @property
    def k(self) -> int:
        return len(self.halves[0])

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of the rows' halves to the centroids."""
        cut = self.halves[0].shape[1]
        return [np.maximum(0, (p * p).sum(1)[:, None] - 2 * p @ c.T + (c * c).sum(1)) for p, c in zip((x[:, :cut], x[:, cut:]), self.halves)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        d1, d2 = self.distances(x)
        return d1.argmin(1).astype(np.int64) * self.k + d2.argmin(1)


def _kmeans(p: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = p[rng.choice(len(p), k, replace=False)].copy()
    for _ in range(rounds):
        a = (p @ c.T * 2 - (c * c).sum(1)).argmax(1)
        order = np.argsort(a, kind="stable")
        n = np.bincount(a, minlength=k)
        first = np.flatnonzero(np.append(True, np.diff(a[order]) != 0))
        s = np.add.reduceat(p[order], first, axis=0)
        c[a[order][first]] = s / n[a[order][first], None]
        if (n == 0).any():
            c[n == 0] = p[rng.choice(len(p), int((n == 0).sum()))]
    return c


def fit(vectors: DataFrame, n: int, dim: int, *, sample: int = 16384, max_centroids: int = 1024, seed: int = 7) -> Quantiser:
    """Centroids from about ``sample`` of the ``n`` vectors (columns ``id`` and ``v``)."""
    picked = _picked(vectors, n, sample, seed).select("v").toArrow()
    x = unit(unpack(picked.column("v"), dim)) if picked.num_rows else np.zeros((1, dim), np.float32)
    rng = np.random.default_rng(seed)
    k = int(max(1, min(max_centroids, round(n**0.5 / 1.3), len(x))))
    half = dim // 2
    return Quantiser([_kmeans(x[:, :half], k, rng), _kmeans(x[:, half:], k, rng)])


def _picked(vectors: DataFrame, n: int, sample: int, seed: int) -> DataFrame:
    """About ``sample`` of ``n`` vectors, by a hash of their ids."""
    share = min(1.0, sample / max(n, 1))
    return vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * sample)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def walk(d1: np.ndarray, d2: np.ndarray, count, reach: int, depth: int) -> list[tuple[int, int]]:
    """Occupied cells in ascending d1[i] + d2[j] until they hold ``reach`` vectors; ``count`` gives a cell's size.

    Only the ``depth`` nearest centroids of either half are sorted at first, four times as many when a walk needs more.
    """
    depth = min(depth, len(d1))
    o1, o2 = (np.argsort(d) if depth == len(d) else _smallest(d, depth) for d in (d1, d2))
    s1, s2, o1, o2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
    # no cell beyond the sorted centroids is nearer than this
    bound = math.inf if depth == len(d1) else min(s1[-1] + s2[0], s1[0] + s2[-1])
    heap, out, met = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and met < reach:
        s, i, j = heapq.heappop(heap)
        if s > bound:
            break
        if n := count(o1[i], o2[j]):
            out.append((o1[i], o2[j]))
            met += n
        if j + 1 < depth:
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < depth:
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out if met >= reach or depth == len(d1) else walk(d1, d2, count, reach, 4 * depth)


def _smallest(d: np.ndarray, m: int) -> np.ndarray:
    p = np.argpartition(d, m - 1)[:m]
    return p[np.argsort(d[p])]


def _cells(q: Quantiser, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u, n = np.unique(q.cells(unit(unpack(b.column(0), dim))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n.astype(np.int64))], ["cell", "n"])

    return run


@dataclass
class _Layout:
    """Sizes of the occupied cells and the bin of each; the blocks of entries and shares of visitors of every bin."""

    cell: np.ndarray
    n: np.ndarray
    bin: np.ndarray
    blocks: np.ndarray
    shares: np.ndarray
    reach: np.ndarray  # by first-half centroid
    rows: float = 0.0  # sent to bins, as estimated


def _layout(cells: pa.Table, k: int, bin_rows: int, reach: int) -> _Layout:
    cell, n = cells.column("cell").to_numpy(), cells.column("n").to_numpy()
    o = np.argsort(cell)
    cell, n = cell[o], n[o]
    row = cell // k
    before = np.cumsum(n) - n
    start = before[np.searchsorted(row, row)]  # entries before the cell's first-half group
    _, bins = np.unique(np.stack([row, (before - start) // bin_rows], 1), axis=0, return_inverse=True)
    bins = bins.reshape(-1)
    bins = np.where(n > bin_rows, bins.max(initial=0) + 1 + np.arange(len(bins)), bins)  # a hot cell has a bin to itself
    _, bins = np.unique(bins, return_inverse=True)
    held = np.bincount(bins, n)
    return _Layout(cell, n, bins.astype(np.int64), np.maximum(1, np.ceil(held / BLOCK_ROWS)).astype(np.int64), np.ones(len(held), np.int64), np.full(k, reach, np.int64), float(n.sum()))


def _true_partners(q: Quantiser, ids: np.ndarray, segs: np.ndarray, x: np.ndarray, dim: int, top: int, least: float):
    """Arrow function (id, seg, v) -> query, score, cell: the best partners of the probes ``x`` among the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(x), top)
        for b in batches:
            if b.num_rows:
                y = unpack(b.column(2), dim)
                g = x @ y.T
                g[(segs[:, None] == b.column(1).to_numpy()[None, :]) | (ids[:, None] == b.column(0).to_numpy()[None, :])] = -2
                best.see(np.arange(len(x)), g, q.cells(unit(y)), least)
        a, c, s = best.lists(np.arange(len(x)), least)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(s.astype(np.float64)), pa.array(c)], ["query", "score", "cell"])

    return run


def _measure(vectors: DataFrame, q: Quantiser, lay: _Layout, dim: int, top: int, least: float, recall: float, probes: int, seed: int = 11) -> None:
    """Set the reach of every region, and the shares of bins, by what the probes need."""
    n = int(lay.n.sum())
    s = _picked(vectors, n, probes, seed).select("id", "seg", "v").toArrow()
    if not s.num_rows or len(lay.cell) < 2:
        return
    raw = unpack(s.column("v"), dim)
    ids, segs, x = s.column("id").to_numpy(), s.column("seg").to_numpy(), unit(raw)
    found = vectors.select("id", "seg", "v").mapInArrow(_true_partners(q, ids, segs, raw, dim, top, least), "query long, score double, cell long")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cell"))).where(F.col("r") <= top).select("query", "cell").toArrow()
    query, cell = found.column("query").to_numpy(), found.column("cell").to_numpy()
    d1, d2 = q.distances(x)
    c1, c2 = lay.cell // q.k, lay.cell % q.k
    by_bin = np.argsort(lay.bin, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(lay.bin[by_bin]) != 0))
    need = np.zeros(len(query))
    for r in np.unique(query).tolist():
        mine = np.flatnonzero(query == r)
        dist = d1[r][c1] + d2[r][c2]
        d = np.minimum.reduceat(dist[by_bin], first)[lay.bin[np.searchsorted(lay.cell, cell[mine])]]  # when the partners' bins are reached
        near = dist < d.max()
        o = np.argsort(dist[near])
        met = np.append(0, np.cumsum(lay.n[near][o]))
        need[mine] = met[np.searchsorted(dist[near][o], d)] + 1
    own1 = d1.argmin(1)
    region = _regions(q.halves[0])
    if len(need):
        far = lambda z: int(np.quantile(z, recall, method="higher"))
        every = far(need)
        for g in range(REGIONS):
            z = need[region[own1[query]] == g]
            here = np.flatnonzero(region == g)
            lay.reach[here] = np.maximum(lay.reach[here], far(z) if len(z) >= 64 else every)
    visits = np.zeros(len(lay.blocks))
    for r in range(len(x)):
        dist = d1[r][c1] + d2[r][c2]
        o = _smallest(dist, min(len(dist), int(lay.reach[own1[r]])))  # a cell holds one vector at least
        met = np.cumsum(lay.n[o]) - lay.n[o]
        visits[np.unique(lay.bin[o[met < lay.reach[own1[r]]]])] += 1
    visits *= n / len(x)
    lay.shares = np.maximum(1, np.ceil(visits / VISIT_ROWS)).astype(np.int64)
    held = np.bincount(lay.bin, lay.n)
    lay.rows = float((visits * lay.blocks + held * lay.shares).sum())


def _regions(c: np.ndarray) -> np.ndarray:
    """The region of every first-half centroid: near ones together."""
    g = min(REGIONS, len(c))
    rng = np.random.default_rng(13)
    centre = _kmeans(c, g, rng)
    return (c @ centre.T * 2 - (centre * centre).sum(1)).argmax(1)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _route(q: Quantiser, lay: _Layout, dim: int, depth: int):
    """Arrow function (id, seg, v) -> key, home, id, seg, v: each vector to its own bin and to every bin it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = dict(zip(lay.cell.tolist(), range(len(lay.cell))))
        size, bins, reach = lay.n.tolist(), lay.bin.tolist(), lay.reach.tolist()
        blocks, shares = lay.blocks.tolist(), lay.shares.tolist()
        base = (np.cumsum(lay.blocks * lay.shares) - lay.blocks * lay.shares).tolist()
        k = q.k

        def count(i, j):
            p = at.get(i * k + j)
            return 0 if p is None else size[p]

        for b in batches:
            if not b.num_rows:
                continue
            ids, segs, x = b.column(0).to_numpy(), b.column(1).to_numpy(), unpack(b.column(2), dim)
            drawn = ((ids.astype(np.uint64) * _ODD) >> np.uint64(33)).tolist()
            for lo in range(0, len(x), 2048):
                part = unit(x[lo : lo + 2048])
                d1, d2 = q.distances(part)
                own1, own2 = d1.argmin(1).tolist(), d2.argmin(1).tolist()
                who, keys, home = [], [], []
                for r, (c1, c2) in enumerate(zip(own1, own2)):
                    mine, draw = bins[at[c1 * k + c2]], drawn[lo + r]
                    block = base[mine] + draw % blocks[mine] * shares[mine]
                    to = {block + j: True for j in range(shares[mine])}
                    for c in {mine, *(bins[at[i * k + j]] for i, j in walk(d1[r], d2[r], count, reach[c1], depth))}:
                        share = base[c] + draw // blocks[c] % shares[c]
                        for i in range(blocks[c]):
                            to.setdefault(share + i * shares[c], False)
                    who += [lo + r] * len(to)
                    keys += to
                    home += to.values()
                w = np.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)), pa.array(np.array(home, bool)), pa.array(ids[w]), pa.array(segs[w]), pack(x[w])], ["key", "home", "id", "seg", "v"])

    return run


class _Best:
    """The best ``top`` partners so far of each of n vectors."""

    def __init__(self, n: int, top: int):
        self.score, self.of = np.full((n, top), -2, np.float32), np.zeros((n, top), np.int64)

    def see(self, at: np.ndarray, m: np.ndarray, cols: np.ndarray, least: float) -> None:
        """Scores ``m`` of the vectors ``at`` with the vectors ``cols``."""
        top = self.score.shape[1]
        hot = np.flatnonzero(m.max(1) > np.maximum(self.score[at, -1], np.nextafter(np.float32(least), np.float32(-2))))
        if not len(hot):
            return
        m, at = m[hot], at[hot]
        c = np.argpartition(-m, top - 1, axis=1)[:, :top] if m.shape[1] > top else np.broadcast_to(np.arange(m.shape[1]), m.shape)
        s, o = np.hstack([self.score[at], np.take_along_axis(m, c, 1)]), np.hstack([self.of[at], cols[c]])
        order = np.argsort(-s, axis=1, kind="stable")[:, :top]
        self.score[at], self.of[at] = np.take_along_axis(s, order, 1), np.take_along_axis(o, order, 1)

    def lists(self, of: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = self.score >= least
        return of.repeat(ok.sum(1)), self.of[ok], self.score[ok]


class _Meeting:
    """The rows of one key: first the block of entries, then visitors in any number."""

    def __init__(self, top: int, least: float):
        self.top, self.least, self.parts, self.best = top, least, [], None

    def add(self, home: np.ndarray, ids: np.ndarray, segs: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = int(home.sum())
        if n:
            self.parts.append([np.array(z[:n]) for z in (ids, segs, x)])
        if n < len(home) and self.parts:
            self._settle()
            for lo in range(n, len(home), ROWS):
                z = slice(lo, lo + ROWS)
                seen = _Best(len(ids[z]), self.top)
                self._meet(ids[z], segs[z], x[z], seen)
                yield _pairs(*seen.lists(ids[z], self.least))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._settle()
            yield _pairs(*self.best.lists(self.ids, self.least))

    def _settle(self) -> None:
        """All entries are there: compare them with each other."""
        if self.best is None:
            self.ids, self.segs, self.x = (np.concatenate(z) for z in zip(*self.parts))
            self.best = _Best(len(self.ids), self.top)
            for lo in range(0, len(self.ids), ROWS):
                z = slice(lo, lo + ROWS)
                self._meet(self.ids[z], self.segs[z], self.x[z], None)

    def _meet(self, ids: np.ndarray, segs: np.ndarray, x: np.ndarray, seen: _Best | None) -> None:
        for lo in range(0, len(self.ids), COLS):
            e = np.arange(lo, min(lo + COLS, len(self.ids)))
            g = self.x[e] @ x.T
            g[self.segs[e][:, None] == segs[None, :]] = -2
            self.best.see(e, g, ids, self.least)
            if seen is not None:
                seen.see(np.arange(len(ids)), np.ascontiguousarray(g.T), self.ids[e], self.least)


def _pairs(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score.astype(np.float64))], ["a", "b", "score"])


def _rerank(dim: int, top: int, least: float):
    """Arrow function over rows sorted by key, entries first -> a, b, score: the best ``top`` partners of rows met there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, meeting = None, _Meeting(top, least)
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            rows = [b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), b.column(3).to_numpy(), unpack(b.column(4), dim)]
            cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)]):
                if keys[s] != key:
                    yield from meeting.end()
                    key, meeting = keys[s], _Meeting(top, least)
                yield from meeting.add(*[z[s:e] for z in rows])
        yield from meeting.end()

    return run


def _search(vectors: DataFrame, q: Quantiser, dim: int, top: int, least: float, reach: int, recall: float, probes: int, depth: int, bin_rows: int) -> DataFrame:
    cells = vectors.select("v").mapInArrow(_cells(q, dim), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    lay = _layout(cells, q.k, bin_rows, reach)
    if recall > 0:
        _measure(vectors, q, lay, dim, top, least, recall, probes)
    routed = vectors.select("id", "seg", "v").mapInArrow(_route(q, lay, dim, depth), "key long, home boolean, id long, seg long, v binary")
    parts = max(shuffle_partitions(vectors.sparkSession), math.ceil(lay.rows * (4 * dim + 40) / PART_BYTES))
    met = routed.repartition(parts, "key").sortWithinPartitions("key", F.desc("home")).mapInArrow(_rerank(dim, top, least), "a long, b long, score double")
    pairs = met.repartition("a").groupBy("a", "b").agg(F.max("score").alias("score"))
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).drop("r")


def nearest(
    vectors: DataFrame,
    q: Quantiser,
    *,
    dim: int,
    top: int,
    least: float,
    reach: int = 64,
    recall: float = 0.98,
    probes: int = 512,
    depth: int = 48,
    bin_rows: int = 1024,
    copies: bool = True,
) -> DataFrame:
    """``a, b, score``: up to ``top`` best partners of every vector with a dot product of at least ``least``.

    ``vectors`` has ``id`` (unique), ``seg`` (vectors of one ``seg`` are no partners) and ``v`` (packed, of unit length
    unless ``copies`` is false). Read several times, so it should be a written table. ``recall`` 0 takes ``reach`` as it
    is. ``copies`` tells whether more than 2 * ``top`` vectors may be the same.
    """
    search = lambda x: _search(x, q, dim, top, least, reach, recall, probes, depth, bin_rows)
    if not copies:
        return search(vectors)
    keyed = vectors.select("id", "seg", "v", F.xxhash64("v").alias("h"))
    crowded = materialise(keyed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 2 * top).select("h"), "crowded")
    if crowded.isEmpty():
        return search(vectors)
    crowd = keyed.join(crowded, "h")
    some = crowd.withColumn("r", F.row_number().over(Window.partitionBy("h", "v", "seg").orderBy("id"))).where(F.col("r") <= top)
    some = materialise(some.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= 2 * top).select("h", "id", "seg", "v"), "some")
    kept = materialise(keyed.join(crowded, "h", "left_anti").select("id", "seg", "v").unionByName(some.select("id", "seg", "v")), "kept")
    best = materialise(search(kept), "best")
    # the copies that were not indexed: the list of an indexed copy of their own seg, else indexed copies, all of other segs
    rest = crowd.join(some.select("id"), "id", "left_anti")
    twins = some.groupBy("h", "v", "seg").agg(F.min("id").alias("twin"))
    firsts = some.groupBy("h", "v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, top).alias("firsts"))  # 2 * top ids at most
    rest = rest.join(twins, ["h", "v", "seg"], "left").join(firsts, ["h", "v"], "left").select("id", "twin", "firsts")
    with_twin = rest.where("twin is not null").select(F.col("id").alias("a"), "twin").join(best.withColumnRenamed("a", "twin"), "twin").select("a", "b", "score")
    without = rest.where("twin is null").select(F.col("id").alias("a"), F.explode("firsts").alias("b"), F.lit(1.0).alias("score")).where(F.col("score") >= least)
    return best.unionByName(with_twin).unionByName(without)
