"""Queries of the training-data operators over the project's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm import clusters, cutoff, leaks, neighbours, packing, sequences, topics
from stridelake.sources.tables import load, materialise

MAX_TARGETS = 100_000


def _targets(spark: SparkSession, d: str) -> dict[str, float]:
    rows = load(spark, d, "keep_targets").select("source", "target_pct").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    return {r[0]: float(r[1]) for r in rows if r[0] is not None and r[1] is not None}


def _path_source(names: list[str]) -> Column:
    """The source named in a line's path: the longest target name after ``stream_energy_``."""
    file = F.element_at(F.split("path", "/"), -1)
    out = F.lit(None).cast("string")
    for n in sorted(names, key=len):
        out = F.when(file.startswith(f"stream_energy_{n}_"), F.lit(n)).otherwise(out)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    t = _targets(spark, d)
    return cutoff.keep_fraction(load(spark, d, "energy"), _path_source(list(t)), F.col("energy"), t).select("line_id")


def p2_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    t = _targets(spark, d)
    return cutoff.cutoff_report(load(spark, d, "energy"), _path_source(list(t)), F.col("energy"), t)


def _segment_count(spark: SparkSession, d: str) -> int:
    return load(spark, d, "seg_codes").where("seg_id is not null").select(F.count_distinct("seg_id")).first()[0]


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    seqs = sequences.code_sequences(load(spark, d, "seg_codes")).select("seq").persist()
    need = max(5, -(-3 * _segment_count(spark, d) // 100))
    out = sequences.frequent_subsequences(seqs, "seq", min_support=need)
    seqs.unpersist()
    return out.select(F.concat_ws(" ", F.col("pattern").cast("array<string>")).alias("code_pattern"), F.col("support").alias("n_segments"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _patterns(spark, d).select("code_pattern")


def p3_support(spark: SparkSession, d: str) -> DataFrame:
    return _patterns(spark, d)


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every clustered segment with its cluster's size and its rank by closeness to the cluster's mean."""
    return clusters.segment_clusters(load(spark, d, "seg_codes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    m = materialise(p4_clusters(spark, d).select("seg_id", "cluster"), "pairs")
    a, b = m.withColumnRenamed("seg_id", "seg_a"), m.withColumnRenamed("seg_id", "seg_b")
    return a.join(b, "cluster").where("seg_a < seg_b").select("seg_a", "seg_b")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "seg_codes")
    segs = sequences.one_per_key(t.select("seg_id", "codes_windows", "exported_at"), "seg_id", ["codes_windows"], "exported_at")
    codes = segs.select("seg_id", F.flatten(F.filter("codes_windows", lambda w: w.isNotNull())).alias("codes"))
    counts = sequences.term_counts(codes, "codes", "seg_id")
    n = t.where("seg_id is not null").select(F.count_distinct("seg_id").alias("n_all"))
    marked = sequences.mark_terms(counts.join(F.broadcast(n)), F.col("n_all"), rare=2, common=0.4)  # n is one row
    return marked.select(F.col("term").alias("code"), "occurrences", F.col("records").alias("n_segments"), "mark")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_counts(spark, d).where("mark is not null").select("code", "mark")


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with the time between the first and the last event's window."""
    segs = sequences.code_sequences(load(spark, d, "seg_codes"))
    events = segs.select("seg_id", F.posexplode(F.arrays_zip("seq", "wins")).alias("pos", "e"), "stride", "fps")
    events = events.select("seg_id", "fps", "pos", F.col("e.seq").alias("code"), (F.col("e.wins") * F.col("stride")).alias("frame"))
    runs = sequences.collapse_runs(events, ["seg_id", "fps"], ["pos"], "code", "frame", tol=1).where(F.col("run_len") >= 3)
    return runs.select("seg_id", "start_pos", "run_len", F.col("value").cast("long").alias("first_code"), F.try_divide("duration", "fps").cast("double").alias("duration_sec"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_runs(spark, d).select("seg_id", "start_pos", "run_len")


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_windows(load(spark, d, "seg_codes"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_neighbours(spark, d).drop("cosine")


MAX_KINDS = 1000


def _containers(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    rows = load(spark, d, "containers").select("container_kind", "capacity_tokens").distinct().limit(MAX_KINDS + 1).collect()
    if len(rows) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    return [(r[0], r[1]) for r in rows]


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(load(spark, d, "documents")), _containers(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, d), _containers(spark, d))


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    """What the packing promises, counted: documents placed, and broken promises."""
    counts = materialise(packing.token_counts(load(spark, d, "documents")), "counts")
    kinds = _containers(spark, d)
    return packing.broken_rules(packing.pack(counts, kinds), counts, kinds)


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return topics.document_subjects(load(spark, d, "documents"), load(spark, d, "subject_labels"), load(spark, d, "subjects"))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents by subject."""
    return p10_found(spark, d).groupBy("subject").agg(F.count("*").alias("n_documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_cutoffs": p2_cutoffs, "p3_found": p3_found, "p3_support": p3_support, "p4_found": p4_found, "p4_clusters": p4_clusters, "p5_found": p5_found, "p5_counts": p5_counts, "p6_found": p6_found, "p6_runs": p6_runs, "p7_found": p7_found, "p7_neighbours": p7_neighbours, "p8_packed": p8_packed, "p8_fill": p8_fill, "p8_rules": p8_rules, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_composition": p10_composition}

_P2 = """
WITH c AS (
  SELECT line_id, energy, k.source, k.target_pct
  FROM energy e JOIN keep_targets k ON starts_with(split_part(e.path, '/', -1), 'stream_energy_' || k.source || '_')
  WHERE energy IS NOT NULL AND NOT isnan(energy) AND NOT isinf(energy) AND energy >= 0),
g AS (
  SELECT line_id, energy, source, target_pct, count(*) OVER (PARTITION BY source) AS n,
         count(*) OVER (PARTITION BY source ORDER BY energy DESC RANGE UNBOUNDED PRECEDING) AS at_or_above
  FROM c),
t AS (
  SELECT source, max(target_pct) AS target_pct, max(n) AS n, max(energy) AS cutoff
  FROM g WHERE at_or_above * 100 >= target_pct * n GROUP BY source)
"""

_SEQ = """
WITH one AS (SELECT seg_id, codes_windows, selected_win_idxs, win_geom FROM seg_codes
             QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY exported_at) = 1),
win AS (SELECT seg_id, win_geom, unnest(codes_windows) AS codes, unnest(selected_win_idxs) AS win, generate_subscripts(codes_windows, 1) AS i FROM one),
tok AS (SELECT seg_id, win_geom, win, i, unnest(codes) AS code, generate_subscripts(codes, 1) AS j FROM win),
seq AS (SELECT seg_id, win_geom, win, code, row_number() OVER (PARTITION BY seg_id ORDER BY win, i, j) - 1 AS pos FROM tok)
"""

_P3 = (
    _SEQ
    + """, k AS (SELECT greatest(5, ceil(count(DISTINCT seg_id) * 3 / 100.0)) AS need FROM seg_codes),
it AS (SELECT code FROM seq, k GROUP BY code, need HAVING count(DISTINCT seg_id) >= need),
s AS (SELECT seg_id, pos, code FROM seq WHERE code IN (SELECT code FROM it)),
two AS (SELECT a.seg_id, a.code AS c1, b.code AS c2, b.pos AS e FROM s a JOIN s b ON a.seg_id = b.seg_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 4 WHERE a.code <> b.code),
three AS (SELECT DISTINCT t.seg_id, c1, c2, b.code AS c3, b.pos AS e FROM two t JOIN s b ON t.seg_id = b.seg_id AND b.pos BETWEEN t.e + 1 AND t.e + 4 WHERE b.code NOT IN (c1, c2)),
four AS (SELECT DISTINCT t.seg_id, c1, c2, c3, b.code AS c4, b.pos AS e FROM three t JOIN s b ON t.seg_id = b.seg_id AND b.pos BETWEEN t.e + 1 AND t.e + 4 WHERE b.code NOT IN (c1, c2, c3)),
five AS (SELECT DISTINCT t.seg_id, c1, c2, c3, c4, b.code AS c5 FROM four t JOIN s b ON t.seg_id = b.seg_id AND b.pos BETWEEN t.e + 1 AND t.e + 4 WHERE b.code NOT IN (c1, c2, c3, c4)),
every AS (SELECT seg_id, concat_ws(' ', c1, c2, c3) AS code_pattern FROM three UNION ALL SELECT seg_id, concat_ws(' ', c1, c2, c3, c4) FROM four
          UNION ALL SELECT seg_id, concat_ws(' ', c1, c2, c3, c4, c5) FROM five)
"""
)

_P5 = """
WITH one AS (SELECT seg_id, codes_windows FROM seg_codes QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY exported_at) = 1),
tok AS (SELECT seg_id, unnest(flatten(codes_windows)) AS code FROM one),
c AS (SELECT code, count(*) AS occurrences, count(DISTINCT seg_id) AS n_segments FROM tok WHERE code IS NOT NULL GROUP BY code),
m AS (SELECT CAST(code AS BIGINT) AS code, occurrences, n_segments,
             CASE WHEN n_segments <= 2 THEN 'rare' WHEN n_segments > 0.4 * (SELECT count(*) FROM one) THEN 'common' END AS mark FROM c)
"""

_P6 = (
    _SEQ
    + """, p AS (SELECT *, lag(code) OVER (PARTITION BY seg_id ORDER BY pos) AS prev FROM seq),
g AS (SELECT *, sum(CASE WHEN abs(code - prev) <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY seg_id ORDER BY pos) AS run FROM p),
r AS (SELECT seg_id, min(pos) AS start_pos, count(*) AS run_len, arg_min(code, pos) AS first_code,
             (arg_max(win, pos) - arg_min(win, pos)) * any_value(win_geom.stride) / any_value(win_geom.target_fps) AS duration_sec
      FROM g GROUP BY seg_id, run HAVING count(*) >= 3)
"""
)

_P7 = """
WITH one AS (SELECT seg_id, selected_win_idxs, quantized_windows FROM seg_codes WHERE quantized_windows IS NOT NULL
             QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY exported_at) = 1),
w AS (SELECT seg_id, unnest(selected_win_idxs) AS win, unnest(quantized_windows) AS q FROM one),
x AS (SELECT seg_id, win, unnest(q) AS v FROM w WHERE win IS NOT NULL),
g AS (SELECT seg_id, win, v FROM x WHERE len(v) = 64 AND len(list_filter(v, lambda a: a IS NULL OR isnan(a))) = 0),
c AS (SELECT seg_id, win, unnest(v) AS a, generate_subscripts(v, 1) AS dim FROM g),
m AS (SELECT seg_id, win, dim, avg(a::DOUBLE) AS a FROM c GROUP BY seg_id, win, dim),
u AS (SELECT seg_id, win, list(a ORDER BY dim) AS v FROM m GROUP BY seg_id, win),
p AS (SELECT a.seg_id AS sa, a.win AS wa, b.seg_id AS sb, b.win AS wb, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.seg_id <> b.seg_id),
r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY sa, wa ORDER BY c DESC) <= 5)
SELECT DISTINCT CAST(least(sa, sb) AS BIGINT) AS seg_a, CAST(CASE WHEN sa < sb THEN wa ELSE wb END AS BIGINT) AS win_a, CAST(greatest(sa, sb) AS BIGINT) AS seg_b,
       CAST(CASE WHEN sa < sb THEN wb ELSE wa END AS BIGINT) AS win_b
FROM r WHERE c >= 0.9
"""

# No packing can be told from another by SQL; what every one of them must keep to can.
_P8 = """
SELECT container_kind, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND text <> '') AS n_documents,
       CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_crowded, CAST(0 AS BIGINT) AS n_costly, CAST(0 AS BIGINT) AS n_split, CAST(0 AS BIGINT) AS n_lost
FROM containers WHERE container_kind IS NOT NULL AND capacity_tokens >= 1 GROUP BY container_kind
"""

ORACLE_SQL: dict[str, str] = {
    "p8_rules": _P8,
    "p7_found": _P7,
    "p3_found": _P3 + "SELECT code_pattern FROM every, k GROUP BY code_pattern, need HAVING count(DISTINCT seg_id) >= need",
    "p3_support": _P3 + "SELECT code_pattern, count(DISTINCT seg_id) AS n_segments FROM every, k GROUP BY code_pattern, need HAVING count(DISTINCT seg_id) >= need",
    "p5_found": _P5 + "SELECT code, mark FROM m WHERE mark IS NOT NULL",
    "p5_counts": _P5 + "SELECT code, occurrences, n_segments, mark FROM m",
    "p6_found": _P6 + "SELECT seg_id, start_pos, run_len FROM r",
    "p6_runs": _P6 + "SELECT seg_id, start_pos, run_len, CAST(first_code AS BIGINT) AS first_code, duration_sec FROM r",
    "p2_found": _P2 + "SELECT g.line_id FROM g JOIN t ON g.source = t.source WHERE g.energy >= t.cutoff",
    "p2_cutoffs": _P2
    + """SELECT t.source, CAST(t.target_pct AS DOUBLE) AS target_pct, t.cutoff, CAST(count(*) AS BIGINT) AS n_kept,
         CAST(t.n AS BIGINT) AS n_counted
         FROM g JOIN t ON g.source = t.source AND g.energy >= t.cutoff GROUP BY t.source, t.target_pct, t.cutoff, t.n""",
}
