"""Queries on vectors, codes, tracks, data quality, samples and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stridelake.functions import scalars as fn
from stridelake.operators import codes as C
from stridelake.operators import evaluate as E
from stridelake.operators import quality as Q
from stridelake.operators import sampling as O
from stridelake.operators import segmenter as G
from stridelake.operators import series as S
from stridelake.operators import vectors as V
from stridelake.plans.common import DT, LINES_SQL, SERIES_SQL, lines, r8, series
from stridelake.plans.energy import RULE, recursion
from stridelake.sources.tables import load

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- vectors: a segment is five consecutive embeddings --------------------------------------------------------------------

_V = "WITH v AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),\n"
_SEG = _V + "g AS (SELECT id // 5 AS seg, id % 5 AS pos, label, x FROM v), nm AS (SELECT *, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS nrm FROM g),\ne AS (SELECT seg, pos, label, nrm, unnest(x) AS a, generate_subscripts(x, 1) - 1 AS dim FROM nm)\n"


def vectors(spark, d):
    return load(spark, d, "embeddings").where("embedding is not null and label is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def tokens(spark, d):
    """Five vectors of a segment, in order (a fixed number by construction)."""
    v = vectors(spark, d).withColumn("seg", F.floor(F.col("id") / 5).cast("long"))
    return v.groupBy("seg").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "x"))), lambda s: s["x"]).alias("tokens"))


@query("e01_l2_mean", _SEG + "SELECT seg, round(avg(nrm), 8) AS energy FROM nm GROUP BY seg")
def e01(spark, d):
    return tokens(spark, d).select("seg", r8(V.l2_mean(F.col("tokens"))).alias("energy"))


@query(
    "e02_token_diff",
    _SEG + """, s AS (SELECT seg, pos, nrm, sqrt(list_sum(list_transform(list_zip(x, lag(x) OVER (PARTITION BY seg ORDER BY pos)), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS st, lag(pos) OVER (PARTITION BY seg ORDER BY pos) AS pp FROM nm)
    SELECT seg, round(CASE WHEN count(*) < 2 THEN avg(nrm) ELSE avg(CASE WHEN pp IS NOT NULL THEN st END) END, 8) AS energy FROM s GROUP BY seg""",
)
def e02(spark, d):
    return tokens(spark, d).select("seg", r8(V.token_diff_l2_mean(F.col("tokens"))).alias("energy"))


@query(
    "e04_dispatch",
    "WITH " + LINES_SQL.strip() + """ SELECT path, source, round(CASE WHEN source = 'velocity' THEN 2.0 WHEN mode = 'token_diff_l2_mean' THEN 5.0 ELSE (5.0 + 10.0) / 2 END::DOUBLE, 8) AS energy, round(CASE WHEN win % 3 = 0 OR (win % 5 = 0 AND source <> 'velocity') THEN 0.0 ELSE energy END::DOUBLE, 8) AS gated_energy FROM s""",
)
def e04(spark, d):
    """E03 to E05 on a fixed pair of tokens and speeds, and the gating rule."""
    t = F.array(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0)))
    e = V.window_energy(F.col("source"), F.col("mode"), t, F.array(F.lit(1.0), F.lit(3.0)))
    g = V.gated(F.col("energy"), F.col("win") % 3 == 0, F.col("win") % 5 == 0, F.col("source"))
    return series(spark, d).select("path", "source", r8(e).alias("e"), r8(g).alias("gated_energy")).withColumnRenamed("e", "energy")


def _pool(name: str, sql: str):
    @query(f"c01_pool_{name}", sql)
    def run(spark, d):
        return tokens(spark, d).select("seg", F.posexplode(V.POOLS[name](F.col("tokens"))).alias("dim", "v")).select("seg", F.col("dim").cast("long").alias("dim"), r8(F.col("v")).alias("v"))


_pool("mean", _SEG + "SELECT seg, dim, round(avg(a), 8) + 0.0 AS v FROM e GROUP BY seg, dim")
_pool("max", _SEG + "SELECT seg, dim, round(max(a), 8) + 0.0 AS v FROM e GROUP BY seg, dim")
_pool("mean_std", _SEG + "SELECT seg, dim, round(avg(a), 8) + 0.0 AS v FROM e GROUP BY seg, dim UNION ALL SELECT seg, dim + 64, round(stddev_pop(a), 8) FROM e GROUP BY seg, dim")
_pool("first_last", _SEG + "SELECT seg, dim, round(arg_min(a, pos), 8) + 0.0 AS v FROM e GROUP BY seg, dim UNION ALL SELECT seg, dim + 64, round(arg_max(a, pos), 8) + 0.0 FROM e GROUP BY seg, dim")
_pool("attn_norm", _SEG + ", t AS (SELECT seg, sum(nrm) AS t FROM nm GROUP BY seg) SELECT e.seg, dim, round(sum(a * nrm / (t + 1e-8)), 8) + 0.0 AS v FROM e JOIN t USING (seg) GROUP BY e.seg, dim")


@query("c03_standardised", _V + "e AS (SELECT id, unnest(x) AS a, generate_subscripts(x, 1) - 1 AS dim FROM v), m AS (SELECT dim, avg(a) AS mu, stddev_pop(a) AS sd FROM e GROUP BY dim) SELECT id, e.dim, round((a - mu) / CASE WHEN sd < 1e-9 THEN 1.0 ELSE sd END, 5) + 0.0 AS z FROM e JOIN m ON e.dim = m.dim")
def c03(spark, d):
    z = V.standardise(vectors(spark, d)).select("id", F.posexplode("x").alias("dim", "z"))
    return z.select("id", F.col("dim").cast("long").alias("dim"), (F.round("z", 5) + 0.0).alias("z"))


@query("c04_unit_rows", _V + "u AS (SELECT id, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS n FROM v) SELECT id, round(list_sum(list_transform(x, lambda a: abs(a) / greatest(n, 1e-12))), 8) AS l1 FROM u")
def c04(spark, d):
    return V.unit_vectors(vectors(spark, d)).select("id", r8(F.aggregate("x", F.lit(0.0), lambda a, b: a + F.abs(b))).alias("l1"))


@query("c05_pair_distances", _V + "z AS (SELECT 1) SELECT a.id AS i, b.id AS j, round(list_distance(a.x, b.x), 5) AS dist FROM v a JOIN v b ON a.id < b.id WHERE list_distance(a.x, b.x) < 8")
def c05(spark, d):
    """Blocks against blocks; the result keeps distances below 8."""
    return V.pair_distances(vectors(spark, d)).where("dist < 8").withColumn("dist", F.round("dist", 5))


@query("c20_cosine_pairs", _V + "z AS (SELECT 1) SELECT a.id AS i, b.id AS j, round(1 - list_cosine_similarity(a.x, b.x), 5) AS dist FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.x, b.x) > 0.3")
def c20(spark, d):
    return V.pair_distances(vectors(spark, d), "cosine").where("dist < 0.7").withColumn("dist", F.round("dist", 5))


@query("o04_top_pairs", _V + "z AS (SELECT 1) SELECT a.id AS i, b.id AS j, round(list_cosine_similarity(a.x, b.x), 8) AS sim FROM v a JOIN v b ON a.id < b.id ORDER BY sim DESC, i DESC, j DESC LIMIT 10")
def o04(spark, d):
    p = V.pair_distances(vectors(spark, d), "cosine", top=10).select("i", "j", r8(1 - F.col("dist")).alias("sim"))
    return V.top_pairs(p, 10)


@query(
    "c26_knn",
    _V + "z AS (SELECT 1), p AS (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS dist FROM v a JOIN v b ON a.id <> b.id) SELECT i, j, round(dist, 5) AS dist FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(dist, 9), j) <= 3",
)
def c26(spark, d):
    return V.knn_of(V.pair_distances(vectors(spark, d), each=3).withColumn("dist", F.round("dist", 9)), 3).select("i", "j", F.round("dist", 5).alias("dist"))


@query("c21_mean_cosine", _V + "z AS (SELECT 1) SELECT a.label, round(avg(list_cosine_similarity(a.x, b.x)), 8) + 0.0 AS mean_cosine FROM v a JOIN v b ON a.label = b.label AND a.id < b.id GROUP BY a.label")
def c21(spark, d):
    """ICSS over all pairs of a cluster, in closed form."""
    return V.mean_cosine(vectors(spark, d)).where("n > 1").select("label", r8(F.col("mean_cosine")).alias("mean_cosine"))


@query(
    "c06_intra_inter",
    _V + """p AS (SELECT a.label, avg(1 - list_cosine_similarity(a.x, b.x)) AS m FROM v a JOIN v b ON a.label = b.label AND a.id < b.id GROUP BY a.label),
    u AS (SELECT label, x, sqrt(list_sum(list_transform(x, lambda t: t * t))) AS n FROM v), e AS (SELECT label, unnest(x) / n AS a, generate_subscripts(x, 1) AS dim FROM u),
    c AS (SELECT label, list(s ORDER BY dim) AS x FROM (SELECT label, dim, sum(a) AS s FROM e GROUP BY label, dim) GROUP BY label),
    i AS (SELECT avg(1 - list_cosine_similarity(a.x, b.x)) AS inter FROM c a JOIN c b ON a.label < b.label)
    SELECT round(avg(m), 8) AS intra, round(any_value(inter), 8) AS inter, round(avg(m) / (any_value(inter) + 1e-8), 8) AS ratio FROM p, i""",
)
def c06(spark, d):
    x = V.intra_inter_cosine(vectors(spark, d))
    return x.select(*[r8(F.col(c)).alias(c) for c in ("intra", "inter", "ratio")])


@query(
    "c16_matrix_intra_inter",
    _V + """z AS (SELECT 1), p AS (SELECT least(a.label, b.label) AS p, greatest(a.label, b.label) AS q, avg(list_distance(a.x, b.x)) AS m FROM v a JOIN v b ON a.id < b.id GROUP BY 1, 2)
    SELECT round(avg(CASE WHEN p = q THEN m END), 8) AS intra, round(avg(CASE WHEN p <> q THEN m END), 8) AS inter FROM p""",
)
def c16(spark, d):
    v = vectors(spark, d)
    x = V.matrix_intra_inter(V.pair_distances(v), v.select("id", "label"))
    return x.select(r8(F.col("intra")).alias("intra"), r8(F.col("inter")).alias("inter"))


@query(
    "c08_silhouette",
    _V + """z AS (SELECT 1), p AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS s, count(*) AS n FROM v a JOIN v b ON a.id <> b.id GROUP BY 1, 2, 3),
    q AS (SELECT id, label, max(CASE WHEN label = other THEN s / n END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM p GROUP BY id, label)
    SELECT id, label, round(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END, 5) + 0.0 AS s FROM q""",
)
def c08(spark, d):
    return V.silhouette(vectors(spark, d)).select("id", "label", (F.round("s", 5) + 0.0).alias("s"))


_CEN = _V + "e AS (SELECT id, label, unnest(x) AS a, generate_subscripts(x, 1) AS dim FROM v), cd AS (SELECT label, dim, avg(a) AS c, count(*) AS n FROM e GROUP BY label, dim), cv AS (SELECT label, any_value(n) AS n, list(c ORDER BY dim) AS c FROM cd GROUP BY label)\n"


@query(
    "c09_davies_bouldin",
    _CEN + """, s AS (SELECT v.label, avg(list_distance(x, c)) AS s, any_value(c) AS c FROM v JOIN cv ON v.label = cv.label GROUP BY v.label),
    r AS (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label) SELECT round(avg(r), 8) AS davies_bouldin FROM r""",
)
def c09_db(spark, d):
    return V.davies_bouldin(vectors(spark, d)).select(r8(F.col("davies_bouldin")).alias("davies_bouldin"))


@query(
    "c09_calinski_harabasz",
    _CEN + """, g AS (SELECT dim, avg(a) AS m FROM e GROUP BY dim), w AS (SELECT sum((a - c) * (a - c)) AS w FROM e JOIN cd ON e.label = cd.label AND e.dim = cd.dim), b AS (SELECT sum(n * (c - m) * (c - m)) AS b FROM cd JOIN g ON cd.dim = g.dim),
    k AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM v) SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS calinski_harabasz FROM w, b, k""",
)
def c09_ch(spark, d):
    return V.calinski_harabasz(vectors(spark, d)).select(F.round("calinski_harabasz", 5).alias("calinski_harabasz"))


@query("c07_kmeans_sweep")
def c07(spark, d):
    return V.kmeans_sweep(vectors(spark, d), [4, 8, 10])


@query("c11_pca")
def c11(spark, d):
    """Coordinates for a scatter plot."""
    return V.pca(vectors(spark, d), 2)


@query("c12_step_norms", _SEG + "SELECT seg, pos, round(nrm, 8) AS v FROM nm")
def c12(spark, d):
    return tokens(spark, d).select("seg", F.posexplode(V.to_series(F.col("tokens"))).alias("pos", "v")).select("seg", F.col("pos").cast("long").alias("pos"), r8(F.col("v")).alias("v"))


@query("c13_zscores", _SEG + "SELECT seg, pos, round((nrm - avg(nrm) OVER (PARTITION BY seg)) / (stddev_pop(nrm) OVER (PARTITION BY seg) + 1e-8), 4) + 0.0 AS z FROM nm")
def c13(spark, d):
    w = Window.partitionBy("seg")
    t = tokens(spark, d).select("seg", F.posexplode(V.to_series(F.col("tokens"))).alias("pos", "v"))
    return t.select("seg", F.col("pos").cast("long").alias("pos"), (F.round((F.col("v") - F.avg("v").over(w)) / (F.stddev_pop("v").over(w) + 1e-8), 4) + 0.0).alias("z"))


@query("c14_dtw")
def c14(spark, d):
    """Exact warping distance between neighbouring segments' step norms."""
    t = tokens(spark, d).select("seg", V.to_series(F.col("tokens")).alias("v"))
    n = t.select((F.col("seg") - 1).alias("seg"), F.col("v").alias("b"), F.col("seg").alias("j"))
    return V.dtw_pairs(t.join(n, "seg").select(F.col("seg").alias("i"), "j", F.col("v").alias("a"), "b")).withColumn("dist", r8(F.col("dist")))


@query("c15_linkage")
def c15(spark, d):
    v = V.group_sums(vectors(spark, d), F.floor(F.col("id") / 10)).select(F.col("label").alias("id"), F.transform("s", lambda a: a / F.col("n")).alias("x"), F.lit(0).alias("label"))
    return V.average_linkage(V.pair_distances(v), 5)


@query("c24_pick_model")
def c24(spark, d):
    s = V.kmeans_sweep(vectors(spark, d), [4, 8, 10])
    return V.pick_model(s.select(F.col("k").cast("string").alias("model"), "silhouette", F.lit(1.0).alias("ratio"), F.col("k").alias("size")))


@query("a14_dimension_stats", _V + "e AS (SELECT unnest(x) AS a, generate_subscripts(x, 1) - 1 AS dim FROM v) SELECT dim, round(avg(a), 8) + 0.0 AS mean, round(stddev_pop(a), 8) AS sd FROM e GROUP BY dim")
def a14(spark, d):
    st = V.column_stats(vectors(spark, d)).select(F.posexplode(F.arrays_zip("mean", "sd")).alias("dim", "z"))
    return st.select(F.col("dim").cast("long").alias("dim"), r8(F.col("z.mean")).alias("mean"), r8(F.col("z.sd")).alias("sd"))


# --- codes ------------------------------------------------------------------------------------------------------------------

_ONE = "WITH one AS (SELECT seg_id AS seg, codes_windows, selected_win_idxs FROM seg_codes WHERE seg_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY exported_at) = 1),\ntok AS (SELECT seg, unnest(flatten(codes_windows)) AS code, generate_subscripts(flatten(codes_windows), 1) - 1 AS pos FROM one)\n"


def codes(spark, d):
    """Rows of all code sequences, windows as stored; a segment exported repeatedly counts once."""
    t = load(spark, d, "seg_codes").where("seg_id is not null").groupBy(F.col("seg_id").alias("seg")).agg(F.min_by("codes_windows", "exported_at").alias("w"))
    return t.select("seg", F.posexplode(F.flatten("w")).alias("pos", "code")).select("seg", F.col("pos").cast("long").alias("pos"), F.col("code").cast("long").alias("code"))


@query("s10_code_rows", _ONE + "SELECT seg, pos, CAST(code AS BIGINT) AS code FROM tok")
def s10(spark, d):
    return codes(spark, d)


@query("u06_code_counts", _ONE + "SELECT CAST(code AS BIGINT) AS code, count(*) AS n FROM tok WHERE code IS NOT NULL GROUP BY code")
def u06(spark, d):
    return C.frequencies(codes(spark, d))


@query(
    "a13_code_report",
    _ONE + """, f AS (SELECT CAST(code AS BIGINT) AS code, count(*) AS n FROM tok WHERE code IS NOT NULL GROUP BY code)
    SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS "distinct", min(code) AS min_code, max(code) AS max_code, round(avg(n), 8) AS mean_n, round(stddev_pop(n), 8) AS std_n,
    (SELECT string_agg(code, ' ' ORDER BY n DESC, code) FROM (SELECT * FROM f ORDER BY n DESC, code LIMIT 10)) AS most, (SELECT string_agg(code, ' ' ORDER BY n, code) FROM (SELECT * FROM f ORDER BY n, code LIMIT 10)) AS least FROM f""",
)
def a13(spark, d):
    r = C.frequency_report(codes(spark, d))
    text = lambda c: F.concat_ws(" ", F.col(c).cast("array<string>"))
    return r.select("total", "distinct", "min_code", "max_code", r8(F.col("mean_n")).alias("mean_n"), r8(F.col("std_n")).alias("std_n"), text("most").alias("most"), text("least").alias("least"))


_P = _ONE + ", f AS (SELECT code, count(*) AS n FROM tok WHERE code IS NOT NULL GROUP BY code), t AS (SELECT sum(n) AS t FROM f)\n"


@query("a16_perplexity", _P + "SELECT round(pow(2, -sum(n / t * log2(n / t + 1e-10))), 8) AS perplexity, round(pow(2, -sum(n / t * log2(n / t + 1e-10))) / least(2048, any_value(t)), 8) AS normalised FROM f, t")
def a16(spark, d):
    return C.perplexity(codes(spark, d), 2048).select(r8(F.col("perplexity")).alias("perplexity"), r8(F.col("normalised")).alias("normalised"))


@query("a17_entropy", _P + "SELECT round(-sum(n / t * ln(n / t)), 8) AS entropy, round(-sum(n / t * ln(n / t)) / ln(greatest(max(code) + 1, 2048)), 8) AS normalised, count(*) AS \"unique\", round(exp(-sum(n / t * ln(n / t))), 5) AS perplexity FROM f, t")
def a17(spark, d):
    e = C.entropy(codes(spark, d), 2048)
    return e.select(r8(F.col("entropy")).alias("entropy"), r8(F.col("normalised")).alias("normalised"), "unique", F.round("perplexity", 5).alias("perplexity"))


@query("a18_dead_codes", _ONE + "SELECT c AS code FROM range(0, 2048) r(c) WHERE c NOT IN (SELECT code FROM tok WHERE code IS NOT NULL)")
def a18(spark, d):
    return C.dead_codes(codes(spark, d), 2048)


_BOW = _ONE + ", b AS (SELECT seg, CAST(greatest(0, least(2047, code)) AS BIGINT) AS code, count(*) AS n FROM tok WHERE code IS NOT NULL GROUP BY 1, 2)\n"


@query("c17_bag", _BOW + "SELECT seg, code, n, round(n / (sum(n) OVER (PARTITION BY seg) + 1e-8), 8) AS share FROM b")
def c17(spark, d):
    return C.bag(codes(spark, d)).withColumn("share", r8(F.col("share")))


@query(
    "c18_tfidf",
    _BOW + """, k AS (SELECT count(DISTINCT seg) AS k FROM b), df AS (SELECT code, count(*) AS df FROM b GROUP BY code), w AS (SELECT seg, code, n * (ln((1 + k) / (1 + df)) + 1) AS w FROM b JOIN df USING (code), k)
    SELECT seg, code, round(w / sqrt(sum(w * w) OVER (PARTITION BY seg)), 8) AS w FROM w""",
)
def c18(spark, d):
    return C.tfidf(codes(spark, d)).withColumn("w", r8(F.col("w")))


@query(
    "c19_bigrams",
    _ONE + """, p AS (SELECT seg, code, lead(code) OVER (PARTITION BY seg ORDER BY pos) AS nx FROM tok), b AS (SELECT seg, ((1315423911 * code::BIGINT + 2654435761 * nx::BIGINT) % 16384 + 16384) % 16384 AS bucket, count(*) AS n FROM p WHERE code IS NOT NULL AND nx IS NOT NULL GROUP BY 1, 2)
    SELECT seg, bucket, n, round(n / (sum(n) OVER (PARTITION BY seg) + 1e-8), 8) AS share FROM b""",
)
def c19(spark, d):
    return C.bigram_hash(codes(spark, d)).withColumn("share", r8(F.col("share")))


@query("j10_positional_zip", "WITH z AS (SELECT seg_id, unnest(codes_windows) AS c, unnest(quantized_windows) AS v, generate_subscripts(codes_windows, 1) - 1 AS win FROM seg_codes WHERE quantized_windows IS NOT NULL AND codes_windows IS NOT NULL AND len(codes_windows) = len(quantized_windows)) SELECT seg_id, win, count(*) AS n, CAST(sum(c1) AS BIGINT) AS codes FROM (SELECT seg_id, win, unnest(c) AS c1 FROM z WHERE len(c) = len(v)) GROUP BY 1, 2")
def j10(spark, d):
    t = load(spark, d, "seg_codes").where("quantized_windows is not null and codes_windows is not null and size(codes_windows) = size(quantized_windows)")
    return C.positional_zip(t).groupBy("seg_id", "win").agg(F.count("*").alias("n"), F.sum("code").alias("codes"))


@query(
    "s09_vector_rows",
    "SELECT seg_id, count(*) AS n, round(sum(list_sum(v::DOUBLE[])), 3) + 0.0 AS total FROM (SELECT seg_id, unnest(flatten(quantized_windows)) AS v FROM seg_codes WHERE quantized_windows IS NOT NULL) WHERE len(list_filter(v, lambda a: isnan(a))) = 0 GROUP BY seg_id",
)
def s09(spark, d):
    """Vectors as rows, those with NaN left out."""
    t = load(spark, d, "seg_codes").where("quantized_windows is not null").select("seg_id", F.explode(F.flatten("quantized_windows")).alias("v"))
    t = t.where(~F.exists("v", lambda a: F.isnan(a)))
    return t.groupBy("seg_id").agg(F.count("*").alias("n"), (F.round(F.sum(F.aggregate("v", F.lit(0.0), lambda a, b: a + b)), 3) + 0.0).alias("total"))


@query("a15_sidecar_summary", "SELECT seg_id, len(codes_windows) AS n_windows, list_sum(list_transform(codes_windows, lambda w: len(w))) :: BIGINT AS n_codes, list_min(flatten(codes_windows)) AS min_code, list_max(flatten(codes_windows)) AS max_code, epoch_us(exported_at) AS at FROM seg_codes WHERE codes_windows IS NOT NULL")
def a15(spark, d):
    t = load(spark, d, "seg_codes").where("codes_windows is not null")
    n = F.aggregate("codes_windows", F.lit(0).cast("long"), lambda a, w: a + F.size(w))
    return t.select("seg_id", F.size("codes_windows").cast("long").alias("n_windows"), n.alias("n_codes"), F.array_min(F.flatten("codes_windows")).alias("min_code"), F.array_max(F.flatten("codes_windows")).alias("max_code"), F.unix_micros("exported_at").alias("at"))


@query("pred08_min_windows", "SELECT seg_id, count(*) AS n FROM seg_codes WHERE len(codes_windows) > 3 GROUP BY seg_id")
def pred08(spark, d):
    return load(spark, d, "seg_codes").where(F.size("codes_windows") > 3).groupBy("seg_id").agg(F.count("*").alias("n"))


@query("c26_codes_by_source", "WITH t AS (SELECT DISTINCT seg_id, source, codes_windows FROM seg_codes WHERE source IS NOT NULL) SELECT source AS label, CAST(code AS BIGINT) AS code, count(*) AS n FROM (SELECT source, unnest(flatten(codes_windows)) AS code FROM t) GROUP BY 1, 2")
def c26_codes(spark, d):
    t = load(spark, d, "seg_codes").where("source is not null").select("seg_id", "source", "codes_windows").distinct()
    rows = t.select(F.col("seg_id").alias("seg"), F.explode(F.flatten("codes_windows")).alias("code"), "source")
    return rows.groupBy(F.col("source").alias("label"), F.col("code").cast("long").alias("code")).agg(F.count("*").alias("n"))


# --- tracks -------------------------------------------------------------------------------------------------------------------

_TR = """WITH pt AS (SELECT *, row_number() OVER (PARTITION BY file, view_name, t, h, n ORDER BY point_id) AS rn FROM tracks WHERE pt_row IS NOT NULL AND pt_col IS NOT NULL),
p AS (SELECT * FROM pt WHERE rn = 1), v AS (SELECT *, pt_row - lag(pt_row) OVER w AS dr, pt_col - lag(pt_col) OVER w AS dc, h - lag(h) OVER w AS dh FROM p WINDOW w AS (PARTITION BY file, view_name, t, n ORDER BY h)),
sp AS (SELECT *, sqrt(dr * dr + dc * dc) AS speed FROM v WHERE dh = 1)
"""


def points(spark, d):
    """Usable points, a repeated one once."""
    p = load(spark, d, "tracks").where("pt_row is not null and pt_col is not null")
    return p.groupBy("file", "view_name", "t", "h", "n").agg(F.min_by(F.struct("point_id", "pt_row", "pt_col", "vis"), "point_id").alias("b")).select("file", "view_name", "t", "h", "n", "b.*")


def steps(spark, d):
    w = Window.partitionBy("file", "view_name", "t", "n").orderBy("h")
    p = points(spark, d)
    p = p.withColumns({"dr": F.col("pt_row") - F.lag("pt_row").over(w), "dc": F.col("pt_col") - F.lag("pt_col").over(w), "dh": F.col("h") - F.lag("h").over(w)}).where("dh = 1")
    return p.withColumn("speed", F.sqrt(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")))


@query("w08_track_velocity", _TR + "SELECT point_id, round(dr, 8) + 0.0 AS dr, round(dc, 8) + 0.0 AS dc FROM sp")
def w08_tracks(spark, d):
    return steps(spark, d).select("point_id", r8(F.col("dr")).alias("dr"), r8(F.col("dc")).alias("dc"))


@query("pred02_motion_gate", _TR + "SELECT file, view_name, t, round(avg(speed), 8) AS mean_speed, round(avg(CASE WHEN speed > 2 THEN 1.0 ELSE 0.0 END), 8) AS active, avg(speed) < 2 AND avg(CASE WHEN speed > 2 THEN 1.0 ELSE 0.0 END) < 0.1 AS dropped FROM sp GROUP BY 1, 2, 3")
def pred02(spark, d):
    """Dropped if both the mean and the share of active points are small."""
    a = F.avg(F.when(F.col("speed") > 2, 1.0).otherwise(0.0))
    return steps(spark, d).groupBy("file", "view_name", "t").agg(r8(F.avg("speed")).alias("mean_speed"), r8(a).alias("active"), ((F.avg("speed") < 2) & (a < 0.1)).alias("dropped"))


@query(
    "pred03_static_points",
    _TR + """, f AS (SELECT *, arg_min(pt_row, t * 1000 + h) OVER w AS r0, arg_min(pt_col, t * 1000 + h) OVER w AS c0 FROM p WINDOW w AS (PARTITION BY file, view_name, n))
    SELECT file, view_name, n, round(max(sqrt(pow(pt_row - r0, 2) + pow(pt_col - c0, 2))), 8) AS reach FROM f GROUP BY 1, 2, 3 HAVING max(sqrt(pow(pt_row - r0, 2) + pow(pt_col - c0, 2))) > 5""",
)
def pred03(spark, d):
    p = points(spark, d)
    first = p.groupBy("file", "view_name", "n").agg(F.min_by(F.struct("pt_row", "pt_col"), F.col("t") * 1000 + F.col("h")).alias("o"))
    dist = F.sqrt(F.pow(F.col("pt_row") - F.col("o.pt_row"), 2) + F.pow(F.col("pt_col") - F.col("o.pt_col"), 2))
    return p.join(first, ["file", "view_name", "n"]).groupBy("file", "view_name", "n").agg(r8(F.max(dist)).alias("reach")).where("reach > 5")


@query("pred04_moving_tracks", _TR + "SELECT file, view_name, t, n, sum(speed) > 3 AS moving FROM sp GROUP BY 1, 2, 3, 4")
def pred04(spark, d):
    return steps(spark, d).groupBy("file", "view_name", "t", "n").agg((F.sum("speed") > 3).alias("moving"))


@query("pred17_visible_first", _TR + ", z AS (SELECT file, view_name, max(height) AS hh, max(width) AS ww FROM track_files GROUP BY 1, 2) SELECT file, view_name, t, n FROM p JOIN z USING (file, view_name) GROUP BY 1, 2, 3, 4 HAVING coalesce(bool_or(h = 0 AND vis > 0), false) AND bool_and(pt_row > 0 AND pt_row < hh AND pt_col > 0 AND pt_col < ww)")
def pred17(spark, d):
    z = load(spark, d, "track_files").groupBy("file", "view_name").agg(F.max("height").alias("hh"), F.max("width").alias("ww"))
    inside = (F.col("pt_row") > 0) & (F.col("pt_row") < F.col("hh")) & (F.col("pt_col") > 0) & (F.col("pt_col") < F.col("ww"))
    g = points(spark, d).join(z, ["file", "view_name"]).groupBy("file", "view_name", "t", "n").agg(F.coalesce(F.bool_or((F.col("h") == 0) & (F.col("vis") > 0)), F.lit(False)).alias("seen"), F.bool_and(inside).alias("inside"))
    return g.where("seen and inside").select("file", "view_name", "t", "n")


@query("f17_normalised", _TR + ", z AS (SELECT file, view_name, max(height) AS hh, max(width) AS ww FROM track_files GROUP BY 1, 2) SELECT point_id, round(greatest(-1.0, least(1.0, (pt_row - hh / 2.0) / (hh / 2.0)))::DOUBLE, 8) + 0.0 AS u, round(pt_row * 480.0::DOUBLE / hh, 8) + 0.0 AS scaled FROM p JOIN z USING (file, view_name) WHERE hh IS NOT NULL")
def f17(spark, d):
    """F17, F18."""
    z = load(spark, d, "track_files").groupBy("file", "view_name").agg(F.max("height").alias("hh")).where("hh is not null")
    p = points(spark, d).join(z, ["file", "view_name"])
    return p.select("point_id", r8(fn.normalise_coord(F.col("pt_row"), F.col("hh"))).alias("u"), r8(fn.rescale(F.col("pt_row"), F.col("hh"), F.lit(480.0))).alias("scaled"))


_TRAJ = """, z AS (SELECT file, view_name, max(height) AS hh, max(width) AS ww FROM track_files GROUP BY 1, 2),
pr AS (SELECT a.file, a.view_name, a.n, a.t + a.h AS fr, 2.0 * a.pt_row / hh - 1 AS pr, 2.0 * a.pt_col / ww - 1 AS pc, 2.0 * b.pt_row / hh - 1 AS gr, 2.0 * b.pt_col / ww - 1 AS gc
  FROM p a JOIN p b ON a.file = b.file AND a.view_name = b.view_name AND a.n = b.n AND a.h = 2 AND b.h = 0 AND b.t = a.t + 2 JOIN z ON z.file = a.file AND z.view_name = a.view_name WHERE hh IS NOT NULL AND ww IS NOT NULL)
"""


def trajectories(spark, d):
    """Where a point was seen two steps ahead against where it is seen from that frame itself."""
    z = load(spark, d, "track_files").groupBy("file", "view_name").agg(F.max("height").alias("hh"), F.max("width").alias("ww")).where("hh is not null and ww is not null")
    p = points(spark, d)
    a = p.where("h = 2").select("file", "view_name", "n", (F.col("t") + 2).alias("fr"), F.col("pt_row").alias("ar"), F.col("pt_col").alias("ac"))
    b = p.where("h = 0").select("file", "view_name", "n", F.col("t").alias("fr"), F.col("pt_row").alias("br"), F.col("pt_col").alias("bc"))
    j = a.join(b, ["file", "view_name", "n", "fr"]).join(z, ["file", "view_name"])
    u = lambda x, s: 2.0 * F.col(x) / F.col(s) - 1
    return j.select("file", "view_name", "n", "fr", u("ar", "hh").alias("pr"), u("ac", "ww").alias("pc"), u("br", "hh").alias("gr"), u("bc", "ww").alias("gc"))


_W = "(sum(CASE WHEN abs(pr - gr) < {t} THEN 1 ELSE 0 END) + sum(CASE WHEN abs(pc - gc) < {t} THEN 1 ELSE 0 END)) / (2.0 * count(*))"


@query(
    "v07_trajectory_errors",
    _TR + _TRAJ + f"SELECT view_name, round(sum(pow(pr - gr, 2) + pow(pc - gc, 2)) / (2.0 * count(*)), 8) AS mse, round(sum(abs(pr - gr) + abs(pc - gc)) / (2.0 * count(*)), 8) AS l1, round({_W.format(t='0.5 * 2.0 / 480')}, 8) AS accuracy, round(({' + '.join(_W.format(t=f'{k} * 2.0 / 480') for k in range(1, 11))}) / 10.0, 8) AS delta_auc FROM pr GROUP BY view_name",
)
def v07(spark, d):
    e = E.trajectory_errors(trajectories(spark, d), ["view_name"], 0.5, 480.0)
    return e.select("view_name", *[r8(F.col(c)).alias(c) for c in ("mse", "l1", "accuracy", "delta_auc")])


@query(
    "v07_nonzero",
    _TR + """, x AS (SELECT view_name, dr <> 0 AS p, dc <> 0 AS g FROM sp), s AS (SELECT view_name, avg(CASE WHEN p THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN g THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN p = g THEN 1.0 ELSE 0.0 END) AS c, sum(CASE WHEN p AND g THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p AND NOT g THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN g AND NOT p THEN 1 ELSE 0 END) AS fn FROM x GROUP BY view_name)
    SELECT view_name, round(a::DOUBLE, 8) AS nonzero_pred, round(b::DOUBLE, 8) AS nonzero_gt, round(c::DOUBLE, 8) AS nonzero_accuracy, round((2.0 * tp / (2.0 * tp + fp + fn))::DOUBLE, 8) AS nonzero_f1 FROM s""",
)
def v07_nonzero(spark, d):
    s = steps(spark, d).select("view_name", F.col("dr").alias("pv"), F.col("dc").alias("gv"))
    return E.nonzero_scores(s, ["view_name"]).select("view_name", *[r8(F.col(c)).alias(c) for c in ("nonzero_pred", "nonzero_gt", "nonzero_accuracy", "nonzero_f1")])


@query(
    "v07_cross_track",
    _TR + _TRAJ + ", m AS (SELECT a.file, a.view_name, a.n, a.fr, min(sqrt(pow(a.pr - b.gr, 2) + pow(a.pc - b.gc, 2))) AS d FROM pr a JOIN pr b ON a.file = b.file AND a.view_name = b.view_name AND a.n = b.n AND b.fr BETWEEN a.fr - 4 AND a.fr + 4 GROUP BY 1, 2, 3, 4) SELECT round(avg(d), 8) AS cross_track FROM m",
)
def v07_cross(spark, d):
    """Nearest point of the true path within four frames."""
    t = trajectories(spark, d)
    p = t.select("file", "view_name", "n", F.col("fr").alias("pt"), "pr", "pc")
    g = t.select("file", "view_name", "n", F.explode(F.sequence(F.col("fr") - 4, F.col("fr") + 4)).alias("pt"), "gr", "gc")
    j = p.join(g, ["file", "view_name", "n", "pt"]).groupBy("file", "view_name", "n", "pt").agg(F.min(F.sqrt(F.pow(F.col("pr") - F.col("gr"), 2) + F.pow(F.col("pc") - F.col("gc"), 2))).alias("d"))
    return j.agg(r8(F.avg("d")).alias("cross_track"))


@query("v08_code_accuracy", _ONE + ", x AS (SELECT code, lead(code) OVER (PARTITION BY seg ORDER BY pos) AS nx FROM tok) SELECT round(avg(CASE WHEN code = nx THEN 1.0 ELSE 0.0 END)::DOUBLE, 8) AS accuracy FROM x WHERE code IS NOT NULL AND nx IS NOT NULL")
def v08(spark, d):
    """Share of equal ids, here of a sequence against itself one step on."""
    w = Window.partitionBy("seg").orderBy("pos")
    return codes(spark, d).withColumn("nx", F.lead("code").over(w)).where("code is not null and nx is not null").agg(r8(F.avg((F.col("code") == F.col("nx")).cast("double"))).alias("accuracy"))


@query("a25_action_profile", _TR + "SELECT h, round(avg(abs(dr)), 8) AS mean_abs FROM sp GROUP BY h")
def a25(spark, d):
    return steps(spark, d).groupBy("h").agg(r8(F.avg(F.abs("dr"))).alias("mean_abs"))


@query("a12_action_stats", _TR + "SELECT h, round(avg(dr), 8) + 0.0 AS mean, round(stddev_pop(dr), 8) AS sd, round(quantile_cont(dr, 0.01), 8) + 0.0 AS p1, round(quantile_cont(dr, 0.99), 8) + 0.0 AS p99 FROM sp GROUP BY h")
def a12(spark, d):
    g = steps(spark, d).groupBy("h").agg(F.avg("dr").alias("mean"), F.stddev_pop("dr").alias("sd"), F.percentile("dr", [0.01, 0.99]).alias("q"))
    return g.select("h", r8(F.col("mean")).alias("mean"), r8(F.col("sd")).alias("sd"), r8(F.col("q")[0]).alias("p1"), r8(F.col("q")[1]).alias("p99"))


# --- quality ------------------------------------------------------------------------------------------------------------------

VIEWS = ["agentview", "wristview"]


@query("a06_distributions", "SELECT 'dtype' AS field, coalesce(dtype, 'null') AS value, count(*) AS n FROM track_files GROUP BY 2 UNION ALL SELECT 'rank', CAST(coalesce(len(shape), -1) AS VARCHAR), count(*) FROM track_files GROUP BY 2 UNION ALL SELECT 'view', coalesce(view_name, 'null'), count(*) FROM track_files GROUP BY 2")
def a06(spark, d):
    f = load(spark, d, "track_files")
    fields = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in (("dtype", F.coalesce("dtype", F.lit("null"))), ("rank", F.coalesce(F.size("shape"), F.lit(-1)).cast("string")), ("view", F.coalesce("view_name", F.lit("null"))))])
    return f.select(F.explode(fields).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


@query("a07_presence", "SELECT round(avg(CASE WHEN height IS NOT NULL AND width IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE, 8) AS has_size, round(avg(CASE WHEN len(shape) = 4 THEN 1.0 ELSE 0.0 END)::DOUBLE, 8) AS has_rank FROM track_files")
def a07(spark, d):
    share = lambda c: r8(F.avg(F.when(c, 1.0).otherwise(0.0)))
    return load(spark, d, "track_files").agg(share(F.col("height").isNotNull() & F.col("width").isNotNull()).alias("has_size"), share(F.size("shape") == 4).alias("has_rank"))


@query("a08_rollup", "SELECT count(*) AS n, round(coalesce(avg(k), 0), 8) AS mean, round(coalesce(quantile_cont(k, 0.5), 0), 8) AS p50, round(coalesce(quantile_cont(k, 0.9), 0), 8) AS p90 FROM (SELECT count(*) AS k FROM tracks GROUP BY file, view_name)")
def a08(spark, d):
    k = load(spark, d, "tracks").groupBy("file", "view_name").agg(F.count("*").alias("k"))
    q = F.percentile("k", [0.5, 0.9])
    return k.agg(F.count("*").alias("n"), r8(F.coalesce(F.avg("k"), F.lit(0.0))).alias("mean"), r8(F.coalesce(q[0], F.lit(0.0))).alias("p50"), r8(F.coalesce(q[1], F.lit(0.0))).alias("p90"))


@query("a09_resolution", "SELECT view_name, min(h) AS min_h, max(h) AS max_h, round(avg(h), 8) AS mean_h FROM (SELECT file, view_name, CAST(ceil(max(pt_row) + 1) AS BIGINT) AS h FROM tracks WHERE pt_row IS NOT NULL AND NOT isnan(pt_row) GROUP BY 1, 2) GROUP BY view_name")
def a09(spark, d):
    """A09, Q13."""
    r = Q.inferred_resolution(load(spark, d, "tracks").where("pt_row is not null and not isnan(pt_row)"))
    return r.groupBy("view_name").agg(F.min("height").alias("min_h"), F.max("height").alias("max_h"), r8(F.avg("height")).alias("mean_h"))


_CHECK = """WITH i AS (SELECT t.file, t.view_name, count(*) AS nrows, sum(CASE WHEN pt_row IS NULL OR pt_col IS NULL OR isnan(pt_row) OR isnan(pt_col) THEN 1 ELSE 0 END) AS missing,
  avg(CASE WHEN pt_row BETWEEN 0 AND hh AND pt_col BETWEEN 0 AND ww THEN 1.0 WHEN pt_row IS NULL OR pt_col IS NULL OR hh IS NULL OR ww IS NULL THEN CASE WHEN (pt_row < 0 OR pt_row > hh) OR (pt_col < 0 OR pt_col > ww) THEN 0.0 END ELSE 0.0 END) AS a,
  avg(CASE WHEN pt_col BETWEEN 0 AND hh AND pt_row BETWEEN 0 AND ww THEN 1.0 WHEN pt_row IS NULL OR pt_col IS NULL OR hh IS NULL OR ww IS NULL THEN CASE WHEN (pt_col < 0 OR pt_col > hh) OR (pt_row < 0 OR pt_row > ww) THEN 0.0 END ELSE 0.0 END) AS b
  FROM tracks t LEFT JOIN (SELECT file, view_name, max(height) AS hh, max(width) AS ww FROM track_files GROUP BY 1, 2) z ON t.file = z.file AND t.view_name = z.view_name GROUP BY 1, 2),
r AS (SELECT f.file, f.view_name, unnest([CASE WHEN f.view_name NOT IN ('agentview', 'wristview') THEN 'unknown_view' END, CASE WHEN height IS NULL OR width IS NULL THEN 'no_size' END, CASE WHEN coalesce(dtype, '') <> 'float32' THEN 'dtype' END,
  CASE WHEN coalesce(len(shape), 0) <> 4 THEN 'rank' END, CASE WHEN coalesce(shape[2], -1) <> 4 THEN 'horizon' END, CASE WHEN nrows IS NULL THEN 'no_points' END, CASE WHEN missing > 0 THEN 'missing_points' END, CASE WHEN greatest(a, b) < 0.95 THEN 'out_of_bounds' END]) AS reason
  FROM track_files f LEFT JOIN i ON f.file = i.file AND f.view_name = i.view_name), c AS (SELECT DISTINCT file, view_name, reason FROM r WHERE reason IS NOT NULL)
"""


def checks(spark, d):
    return Q.track_checks(load(spark, d, "track_files"), load(spark, d, "tracks"), VIEWS, 4)


@query("q08_track_checks", _CHECK + "SELECT * FROM c")
def q08(spark, d):
    """P13, Q08."""
    return checks(spark, d)


@query("a22_examples", _CHECK + "SELECT reason, count(*) AS n, string_agg(file, ' ' ORDER BY file, view_name) FILTER (r <= 10) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY file, view_name) AS r FROM c) GROUP BY reason")
def a22(spark, d):
    c = checks(spark, d).withColumn("item", F.concat_ws("|", "file", "view_name"))
    return Q.examples(c, "reason", "item").select("reason", "n", F.concat_ws(" ", F.transform("examples", lambda x: F.substring_index(x, "|", 1))).alias("examples"))


@query("j14_missing_views", "SELECT DISTINCT f.file, v AS view_name FROM track_files f, (SELECT unnest(['agentview', 'wristview']) AS v) WHERE NOT EXISTS (SELECT 1 FROM track_files g WHERE g.file = f.file AND g.view_name = v)")
def j14(spark, d):
    """J14, U04."""
    return Q.missing_views(load(spark, d, "track_files"), VIEWS)


@query(
    "q01_index_map",
    "WITH f AS (SELECT file, min(shape[1])::BIGINT AS n, string_agg(DISTINCT view_name, ' ' ORDER BY view_name) AS use_views FROM track_files WHERE len(shape) = 4 AND shape[1] > 0 GROUP BY file), x AS (SELECT file, n, use_views, unnest(range(0, n)) AS start_t FROM f) SELECT file, start_t, least(start_t + 16, n) AS end_t, 16::BIGINT AS rollout_len, use_views FROM x",
)
def q01(spark, d):
    return Q.index_map(load(spark, d, "track_files"), 16).withColumn("use_views", F.concat_ws(" ", "use_views"))


@query("q03_split", "WITH f AS (SELECT DISTINCT file FROM track_files), n AS (SELECT count(*) AS n FROM f) SELECT file FROM f QUALIFY row_number() OVER (ORDER BY file) <= (SELECT round_even(0.8 * n, 0) FROM n)")
def q03(spark, d):
    """Q03, Q04: the share is honoured, so train and validation never overlap."""
    return Q.split_share(load(spark, d, "track_files"), 0.8)


@query("q03_split_rest", "WITH f AS (SELECT DISTINCT file FROM track_files), n AS (SELECT count(*) AS n FROM f) SELECT file FROM f QUALIFY row_number() OVER (ORDER BY file DESC) <= (SELECT round_even(0.2 * n, 0) FROM n)")
def q03_rest(spark, d):
    return Q.split_share(load(spark, d, "track_files"), -0.2)


@query(
    "q09_motion_report",
    """WITH p AS (SELECT t.*, hh, ww, lag(pt_row) OVER w AS lr, lag(pt_col) OVER w AS lc, h - lag(h) OVER w AS dh FROM tracks t LEFT JOIN (SELECT file, view_name, max(height) AS hh, max(width) AS ww FROM track_files GROUP BY 1, 2) z ON t.file = z.file AND t.view_name = z.view_name WINDOW w AS (PARTITION BY t.file, t.view_name, t.t, t.n ORDER BY h, point_id)),
    s AS (SELECT *, CASE WHEN dh = 1 THEN sqrt(pow(pt_row - lr, 2) + pow(pt_col - lc, 2)) END AS speed, pt_row IS NULL OR pt_col IS NULL AS bad FROM p)
    SELECT file, view_name, round(quantile_cont(speed, 0.5), 8) AS median_speed, round(avg(CASE WHEN speed > 0.5 THEN 1.0 WHEN speed IS NOT NULL THEN 0.0 END)::DOUBLE, 8) AS moving_share, round(avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END)::DOUBLE, 8) AS missing_share FROM s GROUP BY 1, 2""",
)
def q09(spark, d):
    m = Q.motion_report(load(spark, d, "tracks"), load(spark, d, "track_files"))
    return m.select("file", "view_name", *[r8(F.col(c)).alias(c) for c in ("median_speed", "moving_share", "missing_share")])


@query("q10_recommendations")
def q10(spark, d):
    m = Q.motion_report(load(spark, d, "tracks"), load(spark, d, "track_files"))
    return Q.recommend(m, load(spark, d, "track_files").select(F.get("shape", F.lit(1)).alias("horizon")).where("horizon is not null"), 16)


@query(
    "q11_media_status",
    """SELECT doc_id, CASE WHEN n_chars = 0 THEN 'empty' WHEN regexp_matches(lower(coalesce(text, '')), 'moov atom|invalid data') OR source = 'run_log' THEN 'corrupt' WHEN n_chars % 7 = 0 AND n_chars <= 200 THEN 'static' ELSE 'ok' END AS status FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL""",
)
def q11(spark, d):
    """P11, P12, Q11, Q12 on a stand-in for a probe table."""
    t = load(spark, d, "documents").where("n_chars is not null and source is not null")
    n = F.col("n_chars")
    p = t.select("doc_id", n.alias("size"), F.when(F.col("source") == "run_log", 1).otherwise(0).alias("exit_code"), F.col("text").alias("message"), F.lit(False).alias("timed_out"), (n % 7).cast("double").alias("diff_ratio"), n.cast("double").alias("diff_mean"), F.lit(0.0).alias("diff_max"), F.lit(False).alias("early_exit"))
    return Q.media_status(p, ["moov atom", "invalid data"], 0.0, 200.0, 1.0).select("doc_id", "status")


@query("q15_completeness", "SELECT file, count(DISTINCT view_name) = 2 AS complete FROM track_files GROUP BY file")
def q15(spark, d):
    return load(spark, d, "track_files").groupBy("file").agg((F.count_distinct("view_name") == 2).alias("complete"))


@query("s13_sample_counts", "SELECT file, coalesce(max(CASE WHEN len(shape) = 4 THEN shape[1] END), max(shape[1]), 0) AS n FROM track_files GROUP BY file")
def s13(spark, d):
    return load(spark, d, "track_files").groupBy("file").agg(F.coalesce(F.max(F.when(F.size("shape") == 4, F.get("shape", F.lit(0)))), F.max(F.get("shape", F.lit(0))), F.lit(0)).alias("n"))


@query("a21_dataset_ratios", "SELECT round(a.n / b.n::DOUBLE, 8) AS files_ratio, round(a.m / b.m::DOUBLE, 8) AS samples_ratio FROM (SELECT count(*) AS n, sum(shape[1]) AS m FROM track_files WHERE view_name = 'agentview') a, (SELECT count(*) AS n, sum(shape[1]) AS m FROM track_files WHERE view_name = 'wristview') b")
def a21(spark, d):
    f = load(spark, d, "track_files")
    of = lambda v, c: F.sum(F.when(F.col("view_name") == v, c))
    one, m = F.lit(1), F.get("shape", F.lit(0))
    return f.agg(r8(of("agentview", one) / of("wristview", one)).alias("files_ratio"), r8(of("agentview", m) / of("wristview", m)).alias("samples_ratio"))


# --- predicates, sets, samples, scalars -------------------------------------------------------------------------------------------


@query("pred05_finite", "SELECT line_id FROM energy WHERE energy IS NOT NULL AND NOT isnan(energy) AND NOT isinf(energy)")
def pred05(spark, d):
    return load(spark, d, "energy").where(S.finite(F.col("energy"))).select("line_id")


@query("pred06_stem_prefix", "SELECT DISTINCT stem FROM energy WHERE stem LIKE 'press%' OR stem LIKE 'weld%'")
def pred06(spark, d):
    return load(spark, d, "energy").where(F.col("stem").startswith("press") | F.col("stem").startswith("weld")).select("stem").distinct()


@query("pred14_pending", "SELECT DISTINCT stem FROM energy WHERE stem IS NOT NULL AND stem NOT IN (SELECT regexp_replace(video, '\\.mp4$', '') FROM seg_docs WHERE doc_kind = 'pred' AND video IS NOT NULL)")
def pred14(spark, d):
    """What has no output yet."""
    from stridelake.sources.writers import pending

    done = load(spark, d, "seg_docs").where("doc_kind = 'pred' and video is not null").select(F.regexp_replace("video", r"\.mp4$", "").alias("stem"))
    return pending(load(spark, d, "energy").where("stem is not null").select("stem").distinct(), done, ["stem"])


@query("pred15_report_paths", "SELECT DISTINCT unnest(regexp_extract_all(text, '([a-z]+[0-9]_[a-z]+_[0-9]{7})', 1)) AS stem FROM documents")
def pred15(spark, d):
    p = "([a-z]+[0-9]_[a-z]+_[0-9]{7})"
    return load(spark, d, "documents").where(F.col("text").rlike(p)).select(F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(1))).alias("stem")).distinct()


@query("pred16_top_k", _BOW + ", p AS (SELECT seg, code, n / sum(n) OVER (PARTITION BY seg) AS prob FROM b), r AS (SELECT *, row_number() OVER w AS r, coalesce(sum(prob) OVER (PARTITION BY seg ORDER BY prob DESC, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WINDOW w AS (PARTITION BY seg ORDER BY prob DESC, code)) SELECT seg, code FROM r WHERE r <= 5 AND before <= 0.25")
def pred16(spark, d):
    b = C.bag(codes(spark, d)).withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("seg"))).select("seg", F.col("code").alias("cls"), "prob")
    return O.top_k(b, "seg", 5, 0.25).select("seg", F.col("cls").alias("code"))


@query("u01_intersect", "SELECT stem FROM energy WHERE stem IS NOT NULL INTERSECT SELECT stem FROM seg_codes")
def u01(spark, d):
    return load(spark, d, "energy").where("stem is not null").select("stem").intersect(load(spark, d, "seg_codes").select("stem"))


@query("u03_union_all", "SELECT stem, 'energy' AS tbl FROM (SELECT DISTINCT stem FROM energy) UNION ALL SELECT stem, 'codes' FROM (SELECT DISTINCT stem FROM seg_codes)")
def u03(spark, d):
    of = lambda t, n: load(spark, d, t).select("stem").distinct().withColumn("tbl", F.lit(n))
    return of("energy", "energy").unionByName(of("seg_codes", "codes"))


@query("u04_except", "SELECT stem FROM seg_codes WHERE stem IS NOT NULL EXCEPT SELECT stem FROM energy")
def u04(spark, d):
    return load(spark, d, "seg_codes").where("stem is not null").select("stem").subtract(load(spark, d, "energy").select("stem"))


@query("o01_ranked", "SELECT seg_id, row_number() OVER (ORDER BY len(codes_windows) DESC, seg_id, exported_at) AS r FROM seg_codes QUALIFY r <= 100")
def o01(spark, d):
    """A top-k report: sort with a full tie-break."""
    t = load(spark, d, "seg_codes").select("seg_id", F.size("codes_windows").alias("n"), "exported_at")
    top = O.first_n(t.withColumn("o", -F.col("n")), 100, "o", "seg_id", "exported_at")
    return top.withColumn("r", F.row_number().over(Window.orderBy("o", "seg_id", "exported_at")).cast("long")).select("seg_id", "r")  # 100 rows


@query("o06_per_group")
def o06(spark, d):
    return O.per_group(load(spark, d, "seg_codes").select("seg_id", "source").where("source is not null").distinct(), "source", "seg_id", 5)


@query("o07_even_places", "WITH n AS (SELECT file, min(shape[1]) AS n FROM track_files WHERE len(shape) = 4 GROUP BY file) SELECT file, string_agg(p, ' ' ORDER BY p) AS places FROM (SELECT DISTINCT file, CAST(round_even(k * (n - 1) / 5.0::DOUBLE, 0) AS BIGINT) AS p FROM n, range(0, 6) r(k)) GROUP BY file")
def o07(spark, d):
    n = load(spark, d, "track_files").where(F.size("shape") == 4).groupBy("file").agg(F.min(F.get("shape", F.lit(0))).alias("n"))
    return n.select("file", F.concat_ws(" ", fn.even_places(F.col("n"), 6).cast("array<string>")).alias("places"))


@query("o08_first_files", "SELECT DISTINCT path FROM energy WHERE path IS NOT NULL ORDER BY path LIMIT 20")
def o08(spark, d):
    return O.first_n(load(spark, d, "energy").where("path is not null").select("path").distinct(), 20, "path")


@query("o09_subset")
def o09(spark, d):
    return O.subset(load(spark, d, "seg_codes").select("seg_id").distinct(), "seg_id", 50)


@query("o10_weighted")
def o10(spark, d):
    return O.weighted(steps(spark, d).groupBy("file", "view_name", "n").agg(F.sum("speed").alias("length")).withColumn("key", F.concat_ws("|", "file", "view_name", "n")), "key", "length", 50).select("key", "length")


@query("o11_random_pairs")
def o11(spark, d):
    """Pairs for a sampled coherence."""
    return O.random_pairs(vectors(spark, d), "label", "id", 100)


@query("o12_bootstrap")
def o12(spark, d):
    return O.bootstrap_mean(series(spark, d).withColumn("key", F.concat_ws("|", "path", "win")), "source", "energy", "key", repeats=50)


@query("o13_epoch_sample")
def o13(spark, d):
    return O.with_replacement(load(spark, d, "seg_codes").select("seg_id"), "seg_id", 100)


@query("o14_shards")
def o14(spark, d):
    return O.shard(load(spark, d, "seg_codes").select("seg_id").distinct(), 4, 1, "seg_id")


@query(
    "o06_sample_rules",
    _TR
    + """, g AS (SELECT DISTINCT seg_id, source FROM seg_codes), l AS (SELECT CAST(label AS VARCHAR) AS grp, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL GROUP BY 1)
    SELECT 'per_group' AS rule, source AS grp, least(5, count(*)) AS n FROM g WHERE source IS NOT NULL GROUP BY source
    UNION ALL SELECT 'subset', 'all', least(50, count(DISTINCT seg_id)) FROM g WHERE seg_id IS NOT NULL
    UNION ALL SELECT 'shards', 'all', count(DISTINCT seg_id) FROM g WHERE seg_id IS NOT NULL
    UNION ALL SELECT 'weighted', 'all', least(50, count(*)) FROM (SELECT DISTINCT file, view_name, n FROM sp)
    UNION ALL SELECT 'pairs', grp, 100 FROM l WHERE n > 1 UNION ALL SELECT 'strange', 'all', 0""",
)
def o06_rules(spark, d):
    """What the seeded samples must keep to: sizes, parts that make up the whole, no row that is not in the input."""
    segs = load(spark, d, "seg_codes").select("seg_id").where("seg_id is not null").distinct()
    one = lambda rule, df, grp=F.lit("all"): df.groupBy(grp.alias("grp")).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "grp", "n")
    shards = O.shard(segs, 4, 0, "seg_id")
    for i in (1, 2, 3):
        shards = shards.unionByName(O.shard(segs, 4, i, "seg_id"))
    pairs = O.random_pairs(vectors(spark, d), "label", "id", 100)
    sub = O.subset(segs, "seg_id", 50)
    out = one("per_group", o06(spark, d), F.col("source")).unionByName(one("subset", sub)).unionByName(one("shards", shards.distinct())).unionByName(one("weighted", o10(spark, d)))
    out = out.unionByName(one("pairs", pairs, F.col("label").cast("string")))
    known = vectors(spark, d).select("id", F.col("label").alias("l"))
    strange = pairs.join(known, F.col("a") == F.col("id"), "left").where("l is null or l <> label or a = b").select("a")
    strange = strange.unionByName(sub.select(F.col("seg_id").alias("a")).join(segs, F.col("a") == F.col("seg_id"), "left_anti"))
    return out.unionByName(strange.agg(F.count("*").alias("n")).select(F.lit("strange").alias("rule"), F.lit("all").alias("grp"), "n"))


@query(
    "f05_label_spec",
    "SELECT spec, CASE WHEN k IN ('quantile', 'value') AND v IS NOT NULL THEN k ELSE 'auto' END AS kind, CASE WHEN k IN ('quantile', 'value') THEN v END AS value FROM (SELECT spec, split_part(spec, ':', 1) AS k, try_cast(split_part(spec, ':', 2) AS DOUBLE) AS v FROM (SELECT unnest(['auto', 'quantile:0.9', 'value:1.5', 'value:x', 'other']) AS spec))",
)
def f05(spark, d):
    s = spark.createDataFrame([(x,) for x in ("auto", "quantile:0.9", "value:1.5", "value:x", "other")], "spec string")
    return s.select("spec", fn.label_spec(F.col("spec")).alias("p")).select("spec", "p.kind", "p.value")


@query("f06_safe_casts", "SELECT doc_id, try_cast(regexp_extract(text, '([0-9]+)', 1) AS BIGINT) AS n, try_cast(lang AS DOUBLE) AS x FROM documents WHERE text IS NOT NULL")
def f06(spark, d):
    n = fn.safe_long(F.nullif(F.regexp_extract("text", "([0-9]+)", 1), F.lit("")))
    return load(spark, d, "documents").where("text is not null").select("doc_id", n.alias("n"), fn.safe_double(F.col("lang")).alias("x"))


@query("f11_dataset_spec", "SELECT * FROM (VALUES ('demo', 'traj', 0.8::DOUBLE), ('demo', 'action', 0.04::DOUBLE), ('custom', 'traj', 0.5::DOUBLE)) t(name, modality, share)")
def f11(spark, d):
    s = spark.createDataFrame([("demo:traj0.8:action0.04",), ("custom:traj0.5",), ("plain",)], "spec string")
    return s.select(F.explode(fn.dataset_spec(F.col("spec"))).alias("x")).select("x.*")


@query("f12_ranges", "SELECT '3-6' AS spec, unnest([3, 4, 5, 6]) AS i UNION ALL SELECT 'all', unnest([0, 1])")
def f12(spark, d):
    s = spark.createDataFrame([("3-6",), ("all",)], "spec string")
    return s.select("spec", F.explode(fn.int_range(F.col("spec"), 2)).alias("i"))


@query("f16_resize", "SELECT DISTINCT height, width, CAST(round_even(height * (480.0::DOUBLE / least(height, width)), 0) AS BIGINT) AS h2, CAST(round_even(width * (480.0::DOUBLE / least(height, width)), 0) AS BIGINT) AS w2 FROM track_files WHERE height IS NOT NULL AND width IS NOT NULL")
def f16(spark, d):
    f = load(spark, d, "track_files").where("height is not null and width is not null").select("height", "width").distinct()
    r = fn.resize_dims(F.col("height"), F.col("width"), 480)
    return f.select("height", "width", r["height"].alias("h2"), r["width"].alias("w2"))


@query("f19_indices", "SELECT i, i // 16 AS r, i % 16 AS c, (i // 16) * 16 + i % 16 AS flat, (least(7, greatest(-7, i // 16 - 8)) + 7) * 15 + (least(7, greatest(-7, i % 16 - 8)) + 7) AS rel FROM range(0, 256) t(i)")
def f19(spark, d):
    t = spark.range(256).select(F.col("id").alias("i"), fn.from_flat(F.col("id"), 16).alias("p"))
    return t.select("i", F.col("p.row").alias("r"), F.col("p.col").alias("c"), fn.flat_index(F.col("p.row"), F.col("p.col"), 16).alias("flat"), fn.relative_index((F.col("p.row") - 8).cast("double"), (F.col("p.col") - 8).cast("double"), 15).alias("rel"))


@query("f21_finite_or_zero", "SELECT line_id, CASE WHEN energy IS NULL OR isnan(energy) OR isinf(energy) THEN 0.0::DOUBLE ELSE energy END AS energy FROM energy")
def f21(spark, d):
    return load(spark, d, "energy").select("line_id", fn.finite_or_zero(F.col("energy")).alias("energy"))


@query("f23_grid", "SELECT round((2 * r + 1) / 4.0::DOUBLE - 1, 8) AS \"row\", round((2 * c + 1) / 4.0::DOUBLE - 1, 8) AS col FROM range(0, 4) a(r), range(0, 4) b(c)")
def f23(spark, d):
    """F22, F23."""
    return spark.range(1).select(F.explode(fn.grid(4)).alias("p")).select(r8(F.col("p.row")).alias("row"), r8(F.col("p.col")).alias("col"))


@query("f24_mixed_radix", "SELECT i, i % 8 + 8 * ((i // 8) % 8) + 64 * ((i // 64) % 6) AS code FROM range(0, 384) t(i)")
def f24(spark, d):
    """F24, F25."""
    i = F.col("id")
    return spark.range(384).select(i.alias("i"), fn.mixed_radix(F.array(i % 8, F.floor(i / 8) % 8, F.floor(i / 64) % 6), [8, 8, 6]).alias("code"))


@query("f26_positional", "SELECT p, d, round(CASE WHEN d % 2 = 0 THEN sin(p / pow(10000.0, d / 8.0::DOUBLE)) ELSE cos(p / pow(10000.0, (d - 1) / 8.0::DOUBLE)) END, 8) + 0.0 AS v FROM range(0, 10) a(p), range(0, 8) b(d)")
def f26(spark, d):
    t = spark.range(10).select(F.col("id").alias("p"), F.posexplode(fn.positional(F.col("id"), 8)).alias("d", "v"))
    return t.select("p", F.col("d").cast("long").alias("d"), r8(F.col("v")).alias("v"))


@query("f27_argmax", _V + "z AS (SELECT 1) SELECT id, list_position(x, list_max(x)) - 1 AS k, round(exp(0.0) / list_sum(list_transform(x, lambda a: exp(a - list_max(x)))), 8) AS p FROM v")
def f27(spark, d):
    """Class and probability of a vector read as logits."""
    return vectors(spark, d).select("id", fn.argmax(F.col("x")).alias("k"), r8(F.array_max(fn.softmax(F.col("x")))).alias("p"))


@query("f28_weights", "SELECT r, round(1 + 2.0 * pow(r / 8.0, 2), 8) AS w, round(-0.25 * pow(1 - (r + 1) / 10.0, 2) * ln((r + 1) / 10.0::DOUBLE), 8) + 0.0 AS f FROM (SELECT i::DOUBLE AS r FROM range(0, 9) t(i))")
def f28(spark, d):
    r = F.col("id").cast("double")
    return spark.range(9).select(r.alias("r"), r8(fn.radial_weight(r, 8.0, 2.0, 2.0)).alias("w"), r8(fn.focal((r + 1) / 10.0, 0.25, 2.0)).alias("f"))


@query("f29_truncated_normal")
def f29(spark, d):
    x = F.col("id") / 10.0 - 1
    return spark.range(21).select("id", r8(fn.truncated_normal_logpdf(x, F.lit(0.2), F.lit(0.5))).alias("logp"))


@query("f31_vector_primitives", _V + "z AS (SELECT 1) SELECT a.id, round(list_dot_product(a.x, b.x), 5) + 0.0 AS dot, round(list_cosine_similarity(a.x, b.x), 8) + 0.0 AS cosine, round(list_distance(a.x, b.x), 8) AS euclidean, round(list_sum(list_transform(a.x, lambda t: abs(t))) / len(a.x), 8) AS mean_abs FROM v a JOIN v b ON b.id = a.id + 1")
def f31(spark, d):
    v = vectors(spark, d)
    n = v.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    return v.join(n, "id").select("id", (F.round(fn.dot(x, y), 5) + 0.0).alias("dot"), r8(fn.cosine(x, y)).alias("cosine"), r8(fn.euclidean(x, y)).alias("euclidean"), r8(fn.mean_abs(x)).alias("mean_abs"))


@query("j12_nearest_reference", "WITH r AS (SELECT (a - 0.5::DOUBLE) * 64 AS rrow, (b - 0.5::DOUBLE) * 64 AS rcol, (a - 1) * 8 + b AS ref FROM range(1, 9) x(a), range(1, 9) y(b)), p AS (SELECT point_id AS id, pt_row AS \"row\", pt_col AS col FROM tracks WHERE pt_row IS NOT NULL AND pt_col IS NOT NULL) SELECT ref, arg_min(id, pow(\"row\" - rrow, 2) + pow(col - rcol, 2) + id * 1e-15) AS id FROM r, p GROUP BY ref")
def j12(spark, d):
    refs = spark.range(64).select((F.col("id") + 1).alias("ref"), ((F.floor(F.col("id") / 8) + 0.5) * 64.0).alias("rrow"), ((F.col("id") % 8 + 0.5) * 64.0).alias("rcol"))
    p = load(spark, d, "tracks").where("pt_row is not null and pt_col is not null").select(F.col("point_id").alias("id"), F.col("pt_row").alias("row"), F.col("pt_col").alias("col"))
    return V.nearest_reference(p, refs)


@query("w15_chunk_ensemble", "WITH a AS (SELECT s, h, s + h AS step, 1.0::DOUBLE + s + 0.1 * h AS v FROM range(0, 20) x(s), range(0, 4) y(h)), r AS (SELECT step, v, row_number() OVER (PARTITION BY step ORDER BY s) - 1 AS age FROM a WHERE v <> 0) SELECT step, round(sum(v * exp(-0.01 * age)) / sum(exp(-0.01 * age)), 8) AS action FROM r GROUP BY step")
def w15(spark, d):
    """Average of the overlapping predictions of a step; the oldest weighs most."""
    a = spark.range(20).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("h"))
    a = a.select("s", (F.col("s") + F.col("h")).alias("step"), (1.0 + F.col("s") + 0.1 * F.col("h")).alias("v")).where("v <> 0")
    w = F.exp(-0.01 * (F.row_number().over(Window.partitionBy("step").orderBy("s")) - 1))
    return a.withColumn("w", w).groupBy("step").agg(r8(F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("action"))


@query("w19_pad", _ONE + ", k AS (SELECT seg, pos, code FROM tok) SELECT s.seg, p AS pos, CAST(coalesce(k.code, 0) AS BIGINT) AS code FROM (SELECT DISTINCT seg FROM one) s CROSS JOIN range(0, 48) r(p) LEFT JOIN k ON k.seg = s.seg AND k.pos = p")
def w19(spark, d):
    """Sequences cut or filled with zeros to 48 places."""
    t = load(spark, d, "seg_codes").where("seg_id is not null").groupBy(F.col("seg_id").alias("seg")).agg(F.flatten(F.min_by("codes_windows", "exported_at")).alias("c"))
    fixed = F.slice(F.concat(F.coalesce("c", F.array().cast("array<int>")), F.array_repeat(F.lit(0), 48)), 1, 48)
    return t.select("seg", F.posexplode(fixed).alias("pos", "code")).select("seg", F.col("pos").cast("long").alias("pos"), F.col("code").cast("long").alias("code"))


@query("t12_capped", "WITH RECURSIVE " + LINES_SQL + "," + recursion(None, G.Rule(on=1.0, max_windows=G.max_windows(2.0, 4, 10))) + "SELECT path, i0, i1 FROM seg")
def t12(spark, d):
    """Segments capped at two seconds."""
    return G.segment(S.positions(series(spark, d)), G.Rule(on=1.0, max_windows=G.max_windows(2.0, 4, 10))).select("path", "i0", "i1")


@query("k13_with_confidence", "WITH RECURSIVE " + LINES_SQL + "," + recursion(None, RULE) + "SELECT seg.path, i0, i1, round(avg(s.energy), 8) AS conf FROM seg JOIN s ON s.path = seg.path AND s.i BETWEEN i0 AND i1 GROUP BY 1, 2, 3")
def k13(spark, d):
    """Segments beside the energies they were cut from."""
    p = S.positions(series(spark, d))
    g = G.segment(p, RULE).withColumn("i", F.explode(F.sequence("i0", "i1")))
    return g.join(p.select("path", "i", "energy"), ["path", "i"]).groupBy("path", "i0", "i1").agg(r8(F.avg("energy")).alias("conf"))
