"""Operators on event sequences: the shared preparation of code sequences, repeated events, term counts and patterns.

A *segment* row carries its windows' codes and the windows' indices. ``code_sequences`` turns the table into one row per
segment: windows in the order of their indices, their codes appended. Defined results: a segment exported repeatedly
counts once (the earliest export); windows whose index is null come last in the order given; null windows add nothing;
a null code keeps its place but equals nothing; a segment without windows has an empty sequence; rows with a null
``seg_id`` are dropped; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: str, cols: list[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` of every key (partial aggregation first, so a key repeated often is no hot spot)."""
    rest = F.struct(*cols)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(rest, F.struct(F.col(order).isNull(), order)).alias("r")).select(key, "r.*")


def code_sequences(segments: DataFrame) -> DataFrame:
    """``seg_id, seq ARRAY<INT>, wins ARRAY<INT>`` (the window of each place), with ``stride`` and ``fps``."""
    s = segments.select("seg_id", "codes_windows", "selected_win_idxs", F.col("win_geom.stride").alias("stride"), F.col("win_geom.target_fps").alias("fps"), "exported_at")
    s = one_per_key(s, "seg_id", ["codes_windows", "selected_win_idxs", "stride", "fps"], "exported_at")
    idx = F.coalesce("selected_win_idxs", F.array().cast("array<int>"))
    rows = F.transform(
        F.coalesce("codes_windows", F.array().cast("array<array<int>>")),
        lambda codes, i: F.struct(F.get(idx, i).isNull().alias("none"), F.get(idx, i).alias("win"), i.alias("i"), F.coalesce(codes, F.array().cast("array<int>")).alias("codes")),
    )
    s = s.withColumn("w", F.array_sort(rows))
    return s.select(
        "seg_id",
        F.flatten("w.codes").alias("seq"),
        F.flatten(F.transform("w", lambda x: F.transform(x["codes"], lambda _: x["win"]))).alias("wins"),
        "stride",
        "fps",
    )


# --- repeated consecutive events ------------------------------------------------------------------------------------


def collapse_runs(df: DataFrame, key: list[str], order: list[str], value: str, time: str, *, tol: float = 0, block: str | None = None) -> DataFrame:
    """Runs of a table with one event a row: ``key, start_pos, start_time, end_time, value, run_len, duration``.

    A run is a longest stretch of events each of which differs by at most ``tol`` from the one before; ``value`` is its
    first event. Boundary-only: ``lag`` keeps the rows that differ from their predecessor, ``lead`` over these starts
    gives the next one, so that differences of positions are the counts and the time of the event before the next start
    ends the run; the last run ends with its sequence's last event. ``block`` names a column (rising with the order) by
    which long sequences are cut; runs that meet at a cut are joined again over the sequence's boundary runs only.
    Positions count from 0 within the sequence. A null event is a run of its own.
    """
    part = [*key, *([block] if block else [])]
    w = Window.partitionBy(*part).orderBy(*order)
    x = df.select(*part, *[c for c in order if c not in part], F.col(value).alias("_v"), F.col(time).alias("_t"))
    x = x.withColumns({"_n": F.row_number().over(w), "_p": F.lag("_v").over(w), "_pt": F.lag("_t").over(w), "_end": F.lead(F.lit(1)).over(w).isNull()})
    start = (F.col("_n") == 1) | ~F.coalesce(F.abs(F.col("_v") - F.col("_p")) <= tol, F.lit(False))
    b = x.withColumn("_start", start).where(F.col("_start") | F.col("_end"))
    # one row for each start, and one past the end
    b = b.withColumn("_r", F.explode(F.array_compact(F.array(
        F.when(F.col("_start"), F.struct(F.col("_n").alias("n"), F.col("_v").alias("v"), F.col("_t").alias("t"), F.col("_p").alias("pv"), F.col("_pt").alias("pt"), F.lit(False).alias("past"))),
        F.when(F.col("_end"), F.struct((F.col("_n") + 1).alias("n"), F.lit(None).cast(df.schema[value].dataType).alias("v"), F.lit(None).cast(df.schema[time].dataType).alias("t"), F.col("_v").alias("pv"), F.col("_t").alias("pt"), F.lit(True).alias("past"))),
    )))).select(*part, "_r.*")
    o = Window.partitionBy(*part).orderBy("n")
    r = b.withColumns({"_len": F.lead("n").over(o) - F.col("n"), "end_time": F.lead("pt").over(o), "_end_v": F.lead("pv").over(o), "_last": F.lead("past").over(o)}).where(~F.col("past"))
    r = r.select(*part, (F.col("n") - 1).cast("long").alias("start_pos"), F.col("t").alias("start_time"), "end_time", F.col("v").alias("value"), F.col("_len").cast("long").alias("run_len"), "_end_v", "_last", (F.col("n") == 1).alias("_first"))
    cols = [*key, "start_pos", "start_time", "end_time", "value", "run_len"]
    if block:
        # how many events lie in the blocks before
        size = r.groupBy(*part).agg(F.sum("run_len").alias("_size"))
        size = size.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy(*key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        r = r.join(size.drop("_size"), part).withColumn("start_pos", F.col("start_pos") + F.col("_before")).drop("_before")
        inner = r.where(~F.col("_first") & ~F.col("_last"))
        k = Window.partitionBy(*key).orderBy("start_pos")
        e = r.where(F.col("_first") | F.col("_last"))
        joins = F.col("_first") & F.coalesce(F.abs(F.col("value") - F.lag("_end_v").over(k)) <= tol, F.lit(False)) & F.coalesce(F.lag("_last").over(k), F.lit(False))
        e = e.withColumn("_j", joins).withColumn("_c", F.sum((~F.col("_j")).cast("int")).over(k.rowsBetween(Window.unboundedPreceding, 0)))
        at = lambda c, f: f(c, "start_pos").alias(c)
        e = e.groupBy(*key, "_c").agg(F.min("start_pos").alias("_s"), at("start_time", F.min_by), at("end_time", F.max_by), at("value", F.min_by), F.sum("run_len").alias("run_len")).withColumnRenamed("_s", "start_pos")
        r = inner.select(*cols).unionByName(e.select(*cols))
    return r.select(*cols, (F.col("end_time") - F.col("start_time")).alias("duration"))


# --- occurrences and records of every term ---------------------------------------------------------------------------


def _counters(flush: int = 1 << 20):
    """Arrow function (record, terms ARRAY<LONG>) sorted by record -> term, occ, recs: counters of the task's terms.

    Each term has its occurrences, its records and the last record seen: a token adds a record only if it comes from
    another one. The counters are sorted arrays; when they exceed ``flush`` terms they are handed on, but for the last
    records of the terms of the record at hand.
    """

    def join(a, b):
        """Counters of tokens, and of tokens of the same or later records: term, occ, recs, first, last."""
        rows = [np.concatenate(z) for z in zip(a, b)]
        o = np.argsort(rows[0], kind="stable")
        term, occ, recs, first, last = (z[o] for z in rows)
        start = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        end = np.append(start[1:], len(term)) - 1
        again = np.zeros(len(term), np.int64)
        again[1:] = (term[1:] == term[:-1]) & (first[1:] == last[:-1])  # the record seen last goes on
        return term[start], np.add.reduceat(occ, start), np.add.reduceat(recs - again, start), first[start], last[end]

    def out(c):
        some = np.flatnonzero((c[1] > 0) | (c[2] > 0))
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in c[:3]], ["term", "occ", "recs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            lists = b.column(1)
            lens = np.diff(lists.offsets.to_numpy())
            lo, hi = lists.offsets[0].as_py(), lists.offsets[-1].as_py()
            values = lists.values.slice(lo, hi - lo)
            record = np.repeat(b.column(0).to_numpy(), lens)
            if values.null_count:
                there = values.is_valid().to_numpy(zero_copy_only=False)
                values, record = values.drop_null(), record[there]
            term = values.to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(term):
                continue
            order = np.lexsort((record, term))
            t, r = term[order], record[order]
            start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            end = np.append(start[1:], len(t)) - 1
            other = np.append(True, (r[1:] != r[:-1]) | (t[1:] != t[:-1]))
            new = t[start], np.diff(np.append(start, len(t))), np.add.reduceat(other.astype(np.int64), start), r[start], r[end]
            held = join(held, new) if held else new
            if len(held[0]) > flush:
                yield out(held)
                on = np.flatnonzero(held[4] == record[-1])
                held = (held[0][on], np.zeros(len(on), np.int64), np.zeros(len(on), np.int64), held[4][on], held[4][on])
        if held:
            yield out(held)

    return run


def term_counts(records: DataFrame, terms: str, record: str | None = None) -> DataFrame:
    """``term, occurrences, records`` for every distinct value of the array column ``terms``.

    Tokens are hash-partitioned by ``record`` (a column without nulls; without it each row is a record) and read in its
    order, so a record may be cut over any number of rows. A record lies in one task, so counters of tasks add up; only
    (term, occurrences, records) triples are shuffled further, whatever share of all tokens a term has. Null terms do
    not count.
    """
    t = F.coalesce(F.col(terms).cast("array<long>"), F.array().cast("array<long>")).alias("t")
    if record is None:
        rows = records.select(F.monotonically_increasing_id().alias("r"), t)
    else:
        rows = records.where(F.col(record).isNotNull()).select(F.col(record).cast("long").alias("r"), t).repartition("r").sortWithinPartitions("r")
    part = rows.mapInArrow(_counters(), "term long, occ long, recs long")
    return part.groupBy("term").agg(F.sum("occ").alias("occurrences"), F.sum("recs").alias("records"))


def mark_terms(counts: DataFrame, n_records: Column, rare: int, common: float) -> DataFrame:
    """``counts`` with ``mark``: rare (in at most ``rare`` records), common (in more than that share of all), or null."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * n_records, "common")
    return counts.withColumn("mark", mark)


# --- frequent subsequences -------------------------------------------------------------------------------------------


def _support_pass(frequent: list, level: int, items: frozenset, max_gap: int):
    """Arrow function seq -> pattern, n: how many of the task's sequences hold each candidate of ``level`` items.

    Every item keeps a bit mask of its places; the mask's length is its last position. An item can extend a prefix only
    if its last position exceeds the prefix's first end, which is asked first; the gap rule is then one mask operation.
    """
    by_prefix: dict[tuple, list[int]] = {}
    known = set(frequent)
    if level == 2:
        by_prefix = {(i,): sorted(items) for i in items}
    else:
        ext: dict[tuple, list[int]] = {}
        for p in frequent:
            ext.setdefault(p[:-1], []).append(p[-1])
        for p in frequent:  # prefix and suffix must both be frequent
            by_prefix[p] = [i for i in ext.get(p[1:], ()) if i not in p]
    prefixes: dict = {}
    for p in known if level > 2 else by_prefix:
        at = prefixes
        for i in p:
            at = at.setdefault(i, {})

    def reach(m: int) -> int:
        r = 0
        for g in range(1, max_gap + 1):
            r |= m << g
        return r

    def run(batches):
        counts: dict[tuple, int] = {}
        for b in batches:
            for seq in b.column(0).to_pylist():
                masks: dict[int, int] = {}
                for pos, c in enumerate(seq or ()):
                    if c in items:
                        masks[c] = masks.get(c, 0) | 1 << pos
                if len(masks) < level:
                    continue
                last = {c: m.bit_length() for c, m in masks.items()}
                todo = [((c,), prefixes[c], masks[c]) for c in masks if c in prefixes]
                while todo:
                    p, node, ends = todo.pop()
                    first_end = (ends & -ends).bit_length()
                    near = reach(ends)
                    if len(p) == level - 1:
                        for i in by_prefix.get(p, ()):
                            if last.get(i, 0) > first_end and i not in p and near & masks[i]:
                                q = (*p, i)
                                counts[q] = counts.get(q, 0) + 1
                    else:
                        for i, below in node.items():
                            if last.get(i, 0) > first_end and (hit := near & masks[i]):
                                todo.append(((*p, i), below, hit))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in counts], pa.list_(pa.int64())), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    return run


def frequent_subsequences(sequences: DataFrame, seq: str, *, min_support: int, min_len: int = 3, max_len: int = 5, max_gap: int = 4) -> DataFrame:
    """``pattern ARRAY<LONG>, support``: ordered patterns of different items held by at least ``min_support`` sequences.

    A step lies at most ``max_gap`` places after the one before. Levels grow by last-position induction; only patterns
    whose prefix and suffix are frequent are tried. What reaches the driver between levels are frequent patterns, of
    which there are at most (patterns of a sequence) x (sequences / min_support): for a support that is a share of all
    sequences, this does not grow with the data.
    """
    spark = sequences.sparkSession
    s = sequences.select(F.col(seq).cast("array<long>").alias("s"))
    items = frozenset(r[0] for r in term_counts(s, "s").where(F.col("records") >= min_support).select("term").collect())
    found: list[tuple[tuple, int]] = []
    frequent: list = [(i,) for i in items]
    if min_len <= 1 and items:
        raise ValueError("patterns of one item are term counts")
    for level in range(2, max_len + 1):
        if not frequent:
            break
        part = s.mapInArrow(_support_pass(frequent, level, items, max_gap), "pattern array<long>, n long")
        rows = part.groupBy("pattern").agg(F.sum("n").alias("n")).where(F.col("n") >= min_support).collect()
        frequent = [tuple(r["pattern"]) for r in rows]
        if level >= min_len:
            found += [(tuple(r["pattern"]), r["n"]) for r in rows]
    return spark.createDataFrame([(list(p), n) for p, n in found], "pattern array<long>, support long")
