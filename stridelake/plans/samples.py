"""Queries on gates, sample assembly and configuration tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stridelake.operators import gates as G
from stridelake.plans.common import r8
from stridelake.plans.vectors import _TR, points, steps, vectors
from stridelake.sources.tables import load, materialise

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "pred01_pixel_gate",
    """WITH v AS (SELECT vec_id // 5 AS win, vec_id AS frame, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
    d AS (SELECT win, list_transform(list_zip(x, lag(x) OVER (PARTITION BY win ORDER BY frame)), lambda z: abs(z[1] - z[2])) AS d, lag(frame) OVER (PARTITION BY win ORDER BY frame) AS p FROM v)
    SELECT win, round(coalesce(avg(list_sum(d) / len(d)) FILTER (p IS NOT NULL), 0), 8) AS mad, round(coalesce(avg(len(list_filter(d, lambda x: x > 1.0)) / len(d)) FILTER (p IS NOT NULL), 0), 8) AS active,
    coalesce(avg(list_sum(d) / len(d)) FILTER (p IS NOT NULL), 0) < 1.1 AND coalesce(avg(len(list_filter(d, lambda x: x > 1.0)) / len(d)) FILTER (p IS NOT NULL), 0) < 0.5 AS dropped FROM d GROUP BY win""",
)
def pred01(spark, d):
    """Embeddings as frames, five to a window."""
    v = vectors(spark, d).select(F.floor(F.col("id") / 5).cast("long").alias("win"), F.col("id").alias("frame"), "x")
    g = G.pixel_gate(v, ["win"], "frame", "x", diff=1.0, mean_below=1.1, share_below=0.5)
    return g.select("win", r8(F.col("mad")).alias("mad"), r8(F.col("active")).alias("active"), "dropped")


@query("q05_samples", _TR + ", z AS (SELECT file, view_name, max(height) AS hh, max(width) AS ww FROM track_files GROUP BY 1, 2) SELECT point_id, round(greatest(-1.0, least(1.0, (pt_row * 480.0::DOUBLE / hh - 240.0) / 240.0))::DOUBLE, 8) + 0.0 AS u_row, round(greatest(-1.0, least(1.0, (pt_col * 640.0::DOUBLE / ww - 320.0) / 320.0))::DOUBLE, 8) + 0.0 AS u_col FROM p JOIN z USING (file, view_name) WHERE hh > 0 AND ww > 0")
def q05(spark, d):
    s = G.samples(points(spark, d), load(spark, d, "track_files"), 480.0, 640.0)
    return s.select("point_id", r8(F.col("u_row")).alias("u_row"), r8(F.col("u_col")).alias("u_col"))


@query("q06_episode", _TR + ", f AS (SELECT min(file) AS file FROM track_files), z AS (SELECT file, view_name FROM track_files GROUP BY 1, 2 HAVING max(height) > 0 AND max(width) > 0) SELECT DISTINCT p.view_name, p.t FROM p JOIN f ON p.file = f.file JOIN z ON z.file = p.file AND z.view_name = p.view_name")
def q06(spark, d):
    first = load(spark, d, "track_files").agg(F.min("file")).first()[0]
    s = G.samples(points(spark, d), load(spark, d, "track_files"), 480.0, 640.0)
    return G.episode(s, first).select("view_name", "t").distinct()


@query("q02_cached_index", "SELECT file, count(*) AS n FROM (SELECT file, unnest(range(0, n)) FROM (SELECT file, min(shape[1])::BIGINT AS n FROM track_files WHERE len(shape) = 4 AND shape[1] > 0 GROUP BY file)) GROUP BY file")
def q02(spark, d):
    """The index map as a stored table that is read instead of being built again."""
    from stridelake.operators.quality import index_map

    return materialise(index_map(load(spark, d, "track_files"), 16), "index_map").groupBy("file").agg(F.count("*").alias("n"))


@query("j11_by_position", "WITH a AS (SELECT seg_id, row_number() OVER (ORDER BY seg_id) - 1 AS i FROM (SELECT DISTINCT seg_id FROM seg_codes)), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT a.i AS position, seg_id, doc_id FROM a JOIN b ON a.i = b.i")
def j11(spark, d):
    """Labels beside rows that share nothing but their order."""
    return G.by_position(load(spark, d, "seg_codes").select("seg_id").distinct(), load(spark, d, "documents").select("doc_id"), "seg_id", "doc_id", 8)


@query("j15_merged_config", "SELECT * FROM (VALUES ('lr', '0.1'), ('name', 'x'), ('size', '7'), ('new', 'true')) t(key, value)")
def j15(spark, d):
    c = lambda *kv: spark.createDataFrame(list(kv), "key string, value string")
    return G.merged_config(c(("lr", "0.5"), ("size", "3")), c(("size", "7"), ("name", "x")), c(("lr", "0.1"), ("new", "true")))


@query("f13_typed", "SELECT * FROM (VALUES ('true', 'boolean', 'true'), ('None', 'null', NULL), ('1.5', 'number', '1.5'), ('[1,2]', 'list', '[1,2]'), ('abc', 'string', 'abc')) t(text, kind, value)")
def f13(spark, d):
    t = spark.createDataFrame([(x,) for x in ("true", "None", "1.5", "[1,2]", "abc")], "text string")
    return t.select("text", G.typed(F.col("text")).alias("p")).select("text", "p.kind", "p.value")


@query("s22_flow_energy", "SELECT vec_id AS id, round(list_sum(list_transform(range(1, 33), lambda i: sqrt(pow(embedding[i]::DOUBLE, 2) + pow(embedding[i + 32]::DOUBLE, 2)))) / 32, 8) AS energy FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL")
def s22(spark, d):
    """Mean magnitude of a flow field, here the two halves of a vector."""
    return vectors(spark, d).select("id", r8(G.flow_magnitude(F.slice("x", 1, 32), F.slice("x", 33, 32))).alias("energy"))


@query("a11_throughput", "SELECT path, count(*) AS n, round(count(*) / nullif((epoch_us(max(written_at)) - epoch_us(min(written_at))) / 1e6, 0), 8) AS per_sec FROM energy WHERE path IS NOT NULL AND written_at IS NOT NULL GROUP BY path")
def a11(spark, d):
    us = F.unix_micros("written_at")
    g = load(spark, d, "energy").where("path is not null and written_at is not null").groupBy("path").agg(F.count("*").alias("n"), ((F.max(us) - F.min(us)) / 1e6).alias("sec"))
    return g.select("path", "n", r8(F.try_divide(F.col("n"), F.col("sec"))).alias("per_sec"))


@query("pred02_gate_of_steps", _TR + "SELECT file, view_name, round(avg(speed), 8) AS mean_speed, avg(speed) < 1 AND avg(CASE WHEN speed > 1 THEN 1.0 ELSE 0.0 END) < 0.2 AS dropped FROM sp GROUP BY 1, 2")
def pred02_steps(spark, d):
    g = G.motion_gate(steps(spark, d), ["file", "view_name"], "dr", "dc", threshold=1.0, min_share=0.2)
    return g.select("file", "view_name", r8(F.col("mean_speed")).alias("mean_speed"), "dropped")
