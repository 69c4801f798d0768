"""Queries for implausible readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators import implausible
from stridelake.sources.tables import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible.implausible(load(spark, d, "energy"), load(spark, d, "tracks"), load(spark, d, "track_files"))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many readings fail for each reason."""
    e = implausible.implausible_energy(load(spark, d, "energy")).withColumn("tbl", F.lit("energy"))
    t = implausible.implausible_points(load(spark, d, "tracks"), load(spark, d, "track_files")).withColumn("tbl", F.lit("tracks"))
    return e.unionByName(t).groupBy("tbl", "reason").agg(F.countDistinct("rec_id").alias("n"))


QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons}

# The rules read anew, without blocks, halos or filters that only save work.
_SPIKE = " OR ".join(
    f"({' AND '.join(['l' + str(a) + ' IS NOT NULL', 'r' + str(b) + ' IS NOT NULL', *[f'm{k} > 4 * greatest(l{a}, r{b})' for k in range(-a, b + 1)]])} AND energy > 4 * greatest(l{a}, r{b}))".replace("m-", "n")
    for a in range(3)
    for b in range(3 - a)
)
_SHIFTS = ", ".join([f"lag(m, {k}) OVER o AS n{k}" for k in (1, 2)] + [f"lead(m, {k}) OVER o AS m{k}" for k in (1, 2)] + ["m AS m0"])
_SIDES = ", ".join(
    [f"max(m) OVER (PARTITION BY path, piece ORDER BY win ROWS BETWEEN {a + 4} PRECEDING AND {a + 1} PRECEDING) AS l{a}" for a in range(3)]
    + [f"max(m) OVER (PARTITION BY path, piece ORDER BY win ROWS BETWEEN {b + 1} FOLLOWING AND {b + 4} FOLLOWING) AS r{b}" for b in range(3)]
)
_STUCK = ", ".join(
    f"min({v}) OVER (PARTITION BY path, piece ORDER BY win ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS lo{i}, max({v}) OVER (PARTITION BY path, piece ORDER BY win ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS hi{i}"
    for i, v in ((1, "fst"), (2, "lst"))
)
_P1 = f"""
WITH good AS (SELECT path, line_id, win_idx AS win, energy FROM energy WHERE path IS NOT NULL AND energy IS NOT NULL AND NOT isnan(energy) AND NOT isinf(energy) AND energy >= 0 AND win_idx BETWEEN 0 AND 49000000),
w AS (SELECT path, win, max(energy) AS m, arg_min(energy, line_id) AS fst, arg_max(energy, line_id) AS lst FROM good GROUP BY path, win),
w1 AS (SELECT *, CASE WHEN win - lag(win) OVER (PARTITION BY path ORDER BY win) <= 32 THEN 0 ELSE 1 END AS cut FROM w),
w2 AS (SELECT *, sum(cut) OVER (PARTITION BY path ORDER BY win) AS piece FROM w1),
w3 AS (SELECT *, {_SHIFTS}, {_SIDES}, {_STUCK}, count(*) OVER (PARTITION BY path, piece ORDER BY win ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k
       FROM w2 WINDOW o AS (PARTITION BY path, piece ORDER BY win)),
w4 AS (SELECT *, CASE WHEN k = 8 AND lo1 > 0 AND hi1 - lo1 < 0.001 * hi1 THEN 1 ELSE 0 END AS s1, CASE WHEN k = 8 AND lo2 > 0 AND hi2 - lo2 < 0.001 * hi2 THEN 1 ELSE 0 END AS s2 FROM w3),
w5 AS (SELECT *, max(s1) OVER b AS f1, max(s2) OVER b AS f2 FROM w4 WINDOW b AS (PARTITION BY path, piece ORDER BY win ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
series AS (SELECT line_id FROM good g JOIN w5 USING (path, win) WHERE {_SPIKE} OR (energy > 0 AND ((f1 = 1 AND abs(energy - fst) < 0.001 * greatest(energy, fst)) OR (f2 = 1 AND abs(energy - lst) < 0.001 * greatest(energy, lst))))),
c1 AS (SELECT path, line_id, win_idx, CASE WHEN win_idx = lag(win_idx) OVER (PARTITION BY path ORDER BY line_id) THEN 0 ELSE 1 END AS new FROM energy WHERE path IS NOT NULL),
c2 AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY line_id) AS run FROM c1),
counter AS (SELECT line_id FROM c2 WHERE win_idx IS NOT NULL QUALIFY count(*) OVER (PARTITION BY path, run) >= 6),
z0 AS (SELECT file, view_name, max(CASE WHEN height > 0 THEN height END) AS h, max(CASE WHEN width > 0 THEN width END) AS w FROM track_files GROUP BY 1, 2),
z1 AS (SELECT file, view_name, coalesce(h, max(h) OVER (PARTITION BY file)) AS h, coalesce(w, max(w) OVER (PARTITION BY file)) AS w FROM z0),
usual AS (SELECT h, w, count(*) AS n FROM z1 WHERE h IS NOT NULL AND w IS NOT NULL GROUP BY 1, 2),
z AS (SELECT file, view_name, coalesce(h, (SELECT arg_max(u.h, n) FROM usual u WHERE u.w = z1.w), (SELECT arg_max(h, n) FROM usual)) AS h, coalesce(w, (SELECT arg_max(u.w, n) FROM usual u WHERE u.h = z1.h), (SELECT arg_max(w, n) FROM usual)) AS w FROM z1),
pt AS (SELECT * FROM tracks WHERE file IS NOT NULL AND pt_row IS NOT NULL AND pt_col IS NOT NULL AND t IS NOT NULL),
md AS (SELECT *, list_sort(list(pt_row) OVER f) AS rs, list_sort(list(pt_col) OVER f) AS cs FROM pt WINDOW f AS (PARTITION BY file, view_name, n ORDER BY t + coalesce(h, 0) RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
jump AS (SELECT point_id FROM md JOIN z USING (file, view_name) WHERE abs(pt_row - rs[len(rs) // 2 + 1]) > 0.2 * z.h OR abs(pt_col - cs[len(cs) // 2 + 1]) > 0.2 * z.w),
s1 AS (SELECT *, dense_rank() OVER (PARTITION BY file, view_name, n ORDER BY t) AS tn FROM pt),
s2 AS (SELECT *, CASE WHEN tn - lag(tn) OVER (PARTITION BY file, view_name, n, pt_row, pt_col ORDER BY tn) <= 1 THEN 0 ELSE 1 END AS new FROM s1),
s3 AS (SELECT *, sum(new) OVER (PARTITION BY file, view_name, n, pt_row, pt_col ORDER BY tn ROWS UNBOUNDED PRECEDING) AS run FROM s2),
stuck AS (SELECT point_id FROM s3 QUALIFY max(tn) OVER (PARTITION BY file, view_name, n, pt_row, pt_col, run) - min(tn) OVER (PARTITION BY file, view_name, n, pt_row, pt_col, run) >= 4)
SELECT DISTINCT tbl, rec_id FROM (
  SELECT 'energy' AS tbl, line_id AS rec_id FROM energy WHERE (energy IS NOT NULL AND NOT isnan(energy) AND (energy < 0 OR isinf(energy))) OR win_idx < 0 OR win_idx > 49000000
  UNION ALL SELECT 'energy', line_id FROM series UNION ALL SELECT 'energy', line_id FROM counter
  UNION ALL SELECT 'tracks', point_id FROM tracks WHERE NOT isnan(vis) AND (vis < 0 OR vis > 1) UNION ALL SELECT 'tracks', point_id FROM jump UNION ALL SELECT 'tracks', point_id FROM stuck) WHERE rec_id IS NOT NULL
"""
_REASONS = """SELECT tbl, reason, count(DISTINCT rec_id) AS n FROM (
  SELECT 'energy' AS tbl, 'bounds' AS reason, line_id AS rec_id FROM energy WHERE energy IS NOT NULL AND NOT isnan(energy) AND (energy < 0 OR (isinf(energy) AND energy > 0))
  UNION ALL SELECT 'energy', 'window', line_id FROM energy WHERE win_idx < 0 OR win_idx > 49000000
  UNION ALL SELECT 'energy', 'series', line_id FROM series UNION ALL SELECT 'energy', 'counter', line_id FROM counter
  UNION ALL SELECT 'tracks', 'vis', point_id FROM tracks WHERE NOT isnan(vis) AND (vis < 0 OR vis > 1)
  UNION ALL SELECT 'tracks', 'jump', point_id FROM jump UNION ALL SELECT 'tracks', 'stuck', point_id FROM stuck) GROUP BY tbl, reason
"""
ORACLE_SQL: dict[str, str] = {"p1_found": _P1, "p1_reasons": _P1[: _P1.index("SELECT DISTINCT tbl, rec_id")] + _REASONS}
