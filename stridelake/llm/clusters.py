"""Clusters of similar vectors by reciprocal-nearest-neighbour average linkage on a sparse graph.

A node is a cluster: the number of its members and the mean of their unit vectors. The average linkage of two nodes, the
mean cosine over all pairs of members, is the dot product of their means, so it stays exact without any pair being kept.
Each round (1) links every node with its best partners at or above the threshold, found by the inverted multi-index,
(2) divides the graph of the links into its connected components, (3) merges all pairs of nodes that are each other's
best, at once. Average linkage is reducible: no merge can bring nodes of two components to the threshold, and the order
in which mutual best pairs merge does not matter. A component of at most ``local`` nodes therefore goes through all its
rounds of mutual best merges within the task that holds it; a larger one makes one round at a time over all tasks. As
the links are approximate, every node, also one without a link, is looked up again with an index fitted anew; rounds
end when no link is left. Linkages that differ by less than 1e-7, the rounding of the stored means, are ordered by a
hash of the pair, which lets equal vectors pair off in a logarithmic number of rounds. Copies of a vector are one node
from the start.

Components: edges are contracted (every node takes the label of its neighbour first in a random order) until at most
``finish_edges`` are left, which one task joins.

Nothing but counters and the index's bounded tables reaches the driver. Every round's nodes and merges are tables in the
shared folder. A member is traced to its cluster along the merges of the rounds.

Defined results: members whose cosine with their cluster's mean is below ``member_min``, and clusters with fewer than
two members left, are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm import multi_index
from stridelake.llm.vectors import pack, unit_vectors, unpack
from stridelake.sources.tables import materialise

MAX_ROUNDS = 200
STEP = 1e-7  # linkages closer than this count as equal
MERGED = "id long, root long, n long, v binary"  # v is null but for the root


def merge_mutual(ids: np.ndarray, n: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rounds of mutual best merges among some nodes: the root (an index) of each, and the roots' sizes and means."""
    root = np.arange(len(ids))
    at, n, x = root.copy(), n.astype(np.float64), x.astype(np.float64)
    h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)
    while len(at) > 1:
        g = np.round(x @ x.T / STEP)
        mixed = (h[at][:, None] ^ h[at][None, :]) * np.uint64(0xFF51AFD7ED558CCD)
        g += (mixed >> np.uint64(40)) / 2.0**25  # below one half: it only decides between equal linkages
        np.fill_diagonal(g, -np.inf)
        best = g.argmax(1)
        i = np.flatnonzero((best[best] == np.arange(len(at))) & (g[np.arange(len(at)), best] >= least / STEP))
        i = i[i < best[i]]
        if not len(i):
            break
        j = best[i]
        total = n[i] + n[j]
        x[i] = (x[i] * n[i, None] + x[j] * n[j, None]) / total[:, None]
        n[i] = total
        into = np.arange(len(root))
        into[at[j]] = at[i]
        root = into[root]
        stay = np.ones(len(at), bool)
        stay[j] = False
        at, n, x = at[stay], n[stay], x[stay]
    return root, n.astype(np.int64), x


def _merge_components(dim: int, least: float):
    """Arrow function over rows sorted by component: comp, id, n, v -> id, root, n, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def close(rows):
            comp, ids, n, x = rows
            cut = np.flatnonzero(np.append(True, comp[1:] != comp[:-1]))
            for s, e in zip(cut, np.append(cut[1:], len(comp))):
                root, size, mean = merge_mutual(ids[s:e], n[s:e], x[s:e], least)
                own = np.flatnonzero(root == np.arange(e - s))
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:e][own]), pa.array(ids[s:e][own]), pa.array(size), pack(mean)], ["id", "root", "n", "v"])
                gone = np.flatnonzero(root != np.arange(e - s))
                none = pa.nulls(len(gone))
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:e][gone]), pa.array(ids[s:e][root[gone]]), none.cast(pa.int64()), none.cast(pa.binary())], ["id", "root", "n", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append([*(b.column(i).to_numpy() for i in range(3)), unpack(b.column(3), dim)])
            if held[0][0][0] == held[-1][0][-1]:
                continue  # one component so far, which has a bounded size
            rows = [np.concatenate(z) for z in zip(*held)]
            last = np.searchsorted(rows[0], rows[0][-1])
            yield from close([z[:last] for z in rows])
            held = [[z[last:] for z in rows]]
        if held:
            yield from close([np.concatenate(z) for z in zip(*held)])

    return run


def _merge_pairs(dim: int):
    """Arrow function over rows sorted by root: root, id, n, v -> id, root, n, v; a root has one or two rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def fold(root, ids, n, x):
            first = np.flatnonzero(np.append(True, root[1:] != root[:-1]))
            total = np.add.reduceat(n, first)
            mean = np.add.reduceat(x * n[:, None], first, axis=0) / total[:, None]
            own = ids == root
            at = np.cumsum(np.append(True, root[1:] != root[:-1])) - 1
            yield pa.RecordBatch.from_arrays([pa.array(root[first]), pa.array(root[first]), pa.array(total), pack(mean)], ["id", "root", "n", "v"])
            none = pa.nulls(int((~own).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[~own]), pa.array(root[first][at[~own]]), none.cast(pa.int64()), none.cast(pa.binary())], ["id", "root", "n", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = [*(b.column(i).to_numpy() for i in range(3)), unpack(b.column(3), dim).astype(np.float64)]
            rows = [np.concatenate(z) for z in zip(held, rows)] if held else rows
            last = np.searchsorted(rows[0], rows[0][-1])
            if last:
                yield from fold(*[z[:last] for z in rows])
            held = [z[last:] for z in rows]
        if held:
            yield from fold(*held)

    return run


def join_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of some edges, the smallest node of each one's component and the number of nodes in it."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    lab = np.arange(len(ids))
    while len(i):
        li, lj = lab[i], lab[j]
        apart = li != lj
        i, j, li, lj = i[apart], j[apart], li[apart], lj[apart]
        np.minimum.at(lab, np.maximum(li, lj), np.minimum(li, lj))
        while not np.array_equal(up := lab[lab], lab):
            lab = up
    return ids, ids[lab], np.bincount(lab, minlength=len(ids))[lab]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if got:
        yield pa.RecordBatch.from_arrays([pa.array(z) for z in join_edges(*(np.concatenate(z) for z in zip(*got)))], ["id", "comp", "size"])


def components(edges: DataFrame, *, finish_edges: int = 2_000_000) -> DataFrame:
    """``id, comp, size``: the connected component of every node of the written table ``edges`` (``lo``, ``hi``)."""
    e = edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    steps: list[DataFrame] = []
    while e.count() > finish_edges:
        draw = lambda c: F.xxhash64(c, F.lit(len(steps)))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(draw("b").alias("h"), F.col("b").alias("to"))).alias("m"))
        step = materialise(first.select("a", F.when(F.col("m.h") < draw("a"), F.col("m.to")).otherwise(F.col("a")).alias("to")), "step")
        steps.append(step)
        to = step.withColumnRenamed("a", "b").withColumnRenamed("to", "to_b")
        e = e.join(step, "a").join(to, "b").where("to <> to_b").select(F.least("to", "to_b").alias("a"), F.greatest("to", "to_b").alias("b")).distinct()
        e = materialise(e, "contracted")
    left = e.select("a", "b").coalesce(1).mapInArrow(_joined, "id long, comp long, size long")
    if not steps:
        return materialise(left, "components")
    at = steps[0].withColumnRenamed("a", "id")
    for s in steps[1:]:
        at = at.join(s.select(F.col("a").alias("to"), F.col("to").alias("next")), "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    at = at.join(left.select(F.col("id").alias("to"), "comp"), "to", "left").select("id", F.coalesce("comp", "to").alias("comp"))
    at = materialise(at, "labels")
    return materialise(at.join(at.groupBy("comp").agg(F.count("*").alias("size")), "comp").select("id", "comp", "size"), "components")


def _mutual(edges: DataFrame) -> DataFrame:
    """``lo, hi``: the pairs of nodes that are each other's best."""
    rank = F.struct(F.round(F.col("score") / STEP).alias("s"), F.xxhash64("lo", "hi").alias("h"), F.col("lo"), F.col("hi"))
    best = edges.select(F.explode(F.array("lo", "hi")).alias("id"), rank.alias("rank")).groupBy("id").agg(F.max("rank").alias("rank"))
    return best.groupBy("rank.lo", "rank.hi").agg(F.count("*").alias("ends")).where("ends = 2").select("lo", "hi")


def reciprocal_clusters(
    vectors: DataFrame, *, dim: int = 64, least: float = 0.8, links: int = 4, reach: int = 64, recall: float = 0.99, local: int = 2048, finish_edges: int = 2_000_000
) -> tuple[DataFrame, DataFrame]:
    """(``member, id``; ``id, n, v``): the cluster of every member of a cluster of two or more, and the clusters' means.

    ``vectors`` is a written table of ``id`` and unit vectors ``v``.
    """
    keyed = vectors.select("id", "v", F.xxhash64("v").alias("h"))
    first = materialise(keyed.groupBy("h", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "nodes")
    nodes = first.select("id", "n", "v")
    maps: list[DataFrame] = []
    for r in range(MAX_ROUNDS):
        q = multi_index.fit(nodes, nodes.count(), dim, seed=7 + r)
        found = multi_index.nearest(nodes.select("id", F.col("id").alias("seg"), "v"), q, dim=dim, top=links, least=least, reach=reach, recall=recall, copies=False)
        edges = materialise(found.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "score").groupBy("lo", "hi").agg(F.max("score").alias("score")), f"edges{r}")
        if edges.isEmpty():
            break
        comp = components(edges, finish_edges=finish_edges)
        here = nodes.join(comp, "id")
        small = here.where(F.col("size") <= local).select("comp", "id", "n", "v").repartition("comp").sortWithinPartitions("comp", "id")
        merged = small.mapInArrow(_merge_components(dim, least), MERGED)
        large = comp.where(F.col("size") > local).select("id")
        if not large.isEmpty():
            pairs = _mutual(edges.join(large.withColumnRenamed("id", "lo"), "lo"))
            into = pairs.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
            rows = nodes.join(large, "id").join(into, "id", "left").select(F.coalesce("root", "id").alias("root"), "id", "n", "v")
            merged = merged.unionByName(rows.repartition("root").sortWithinPartitions("root").mapInArrow(_merge_pairs(dim), MERGED))
        merged = materialise(merged, f"merged{r}")
        maps.append(merged.where("id <> root").select("id", "root"))
        nodes = materialise(merged.where("id = root").select("id", "n", "v").unionByName(nodes.join(comp.select("id"), "id", "left_anti")), f"nodes{r}")
    else:
        raise RuntimeError(f"links are left after {MAX_ROUNDS} rounds")
    groups = nodes.where("n > 1")
    # a node's members: follow its merges back from the last round to the first, then to the copies
    at = groups.select("id", F.col("id").alias("member"))
    for i, m in enumerate(reversed(maps)):
        gone = m.select(F.col("root").alias("member"), "id").groupBy("member").agg(F.collect_list("id").alias("gone"))  # at most ``local``
        at = at.join(gone, "member", "left").select("id", F.explode(F.concat(F.array("member"), F.coalesce("gone", F.array().cast("array<long>")))).alias("member"))
        if i % 4 == 3:
            at = materialise(at, f"members{i}")
    copied = first.where("n > 1")
    if not copied.isEmpty():
        copies = keyed.join(copied.select("h", "v", F.col("id").alias("member")), ["h", "v"]).where("id <> member").select("member", F.col("id").alias("copy"))
        at = materialise(at, "members")
        at = at.unionByName(copies.join(at, "member").select("id", F.col("copy").alias("member")))
    return at.select("member", "id"), groups


def _cosines(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = unpack(b.column(2), dim).astype(np.float64), unpack(b.column(3), dim).astype(np.float64)
            c = (x * y).sum(1) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c)], ["member", "id", "cosine"])

    return run


def segment_clusters(segments: DataFrame, *, dim: int = 64, least: float = 0.8, member_min: float = 0.85, typical: int = 10) -> DataFrame:
    """``seg_id, cluster, size, typical_rank, cosine``: members by cluster; the ``typical`` most typical ones have a rank."""
    v = materialise(unit_vectors(segments, "segment", dim).select(F.col("seg_id").alias("id"), "v"), "segments")
    members, groups = reciprocal_clusters(v, dim=dim, least=least)
    rows = members.join(groups.select("id", F.col("v").alias("mean")), "id").join(v.withColumnRenamed("id", "member"), "member")
    c = rows.select("member", "id", "v", "mean").mapInArrow(_cosines(dim), "member long, id long, cosine double").where(F.col("cosine") >= member_min)
    c = materialise(c, "members")
    size = c.groupBy("id").agg(F.count("*").alias("size")).where("size > 1")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "member"))
    top = c.select("id", "member", rank.cast("long").alias("typical_rank"), "cosine").where(F.col("typical_rank") <= typical).select("member", "typical_rank")
    return c.join(size, "id").join(top, "member", "left").select(F.col("member").alias("seg_id"), F.col("id").alias("cluster"), "size", "typical_rank", "cosine")
