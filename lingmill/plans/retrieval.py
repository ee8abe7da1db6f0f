"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import retrieval as r
from ..operators.cones import cone_nearest
from . import fixtures as fx
from .registry import query

#: All pairs of different languages with their cosine, and the best of each query.
_SIMS = f"WITH {fx.EMB}, sims AS (SELECT a.lang AS src, b.lang AS tgt, a.pos AS i, b.pos AS j, list_cosine_similarity(a.emb, b.emb) AS sim FROM emb a JOIN emb b ON a.lang <> b.lang)"
_ERRS = _SIMS + ", best AS (SELECT src, tgt, i, j FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt, i ORDER BY sim DESC, j) AS rn FROM sims) WHERE rn = 1), errs AS (SELECT src, tgt, count(*) FILTER (WHERE i <> j) AS err, count(*) AS n FROM best GROUP BY src, tgt)"
_TOP = ", fwd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt, i ORDER BY sim DESC, j) AS rn FROM sims) WHERE rn <= 4), bwd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt, j ORDER BY sim DESC, i) AS rn FROM sims) WHERE rn <= 4)"
_MARGIN = (
    _SIMS
    + _TOP
    + """, ax AS (SELECT src, tgt, i, avg(sim) AS ax FROM fwd GROUP BY src, tgt, i), ay AS (SELECT src, tgt, j, avg(sim) AS ay FROM bwd GROUP BY src, tgt, j),
 sc AS (SELECT src, tgt, i, j, {score} AS score FROM fwd JOIN ax USING (src, tgt, i) JOIN ay USING (src, tgt, j)),
 best AS (SELECT src, tgt, i, j FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt, i ORDER BY score DESC, j) AS rn FROM sc) WHERE rn = 1)
 SELECT src, tgt, count(*) FILTER (WHERE i <> j) AS err, count(*) AS n FROM best GROUP BY src, tgt"""
)



@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x : x::DOUBLE * x::DOUBLE / nullif(list_sum(list_transform(embedding, lambda y : y::DOUBLE * y::DOUBLE)), 0))), 6) AS norm2, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y : y::DOUBLE * y::DOUBLE))), 6) AS first FROM embeddings")
def l2_normalise(spark, d):
    own = fx.load(spark, d, "embeddings").select("vec_id", v.l2_normalise(F.col("embedding")).alias("u"))
    return own.select("vec_id", F.round(v.dot(F.col("u"), F.col("u")), 6).alias("norm2"), F.round(F.element_at("u", 1), 6).alias("first"))


@query(f"WITH {fx.EMB}, s AS (SELECT a.vec_id AS q, b.vec_id AS v, list_cosine_similarity(a.emb, b.emb) AS sim FROM emb a JOIN emb b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0) SELECT q, rn AS rank, v, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, v) AS rn FROM s) WHERE rn <= 5")
def cosine_topk(spark, d):
    own = fx.load(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("emb"))
    top = r.nearest(own.filter("pos % 20 = 0").withColumn("lang", F.lit("q")), own.withColumn("lang", F.lit("v")), F.lit(True), 6).filter("i <> j")
    rank = F.row_number().over(Window.partitionBy("i").orderBy("rank"))
    return top.withColumn("rank", rank).filter("rank <= 5").select(F.col("i").alias("q"), F.col("rank").cast("long").alias("rank"), F.col("j").alias("v"), F.round("sim", 6).alias("sim"))


@query(_ERRS + " SELECT src, tgt, err, n, round(100.0 * err / n, 6) AS xsim FROM errs")
def xsim_pairs(spark, d):
    return r.error_rate(r.xsim(fx.emb(spark, d)))


@query(_ERRS + " SELECT src, tgt, err, n FROM errs")
def xsim_sql_backend(spark, d):
    return r.xsim(fx.emb(spark, d), search=r.sql_nearest)


def _by_cones(block):
    return lambda q, t, pair, k: cone_nearest(q, t, pair, k, block=block)


@query(_ERRS + " SELECT src, tgt, err, n FROM errs")
def xsim_cones(spark, d):
    """Every language in cells of about 16 vectors, visited as far as the cone bounds ask."""
    return r.xsim(fx.emb(spark, d), search=_by_cones(16))


@query(f"WITH {fx.EMB}, s AS (SELECT a.vec_id AS q, b.vec_id AS v, list_cosine_similarity(a.emb, b.emb) AS sim FROM emb a JOIN emb b ON a.vec_id <> b.vec_id) SELECT q, rn AS rank, v, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, v) AS rn FROM s) WHERE rn <= 3")
def knn_cones(spark, d):
    """The three nearest others of every vector, in cells of about 128 vectors."""
    own = fx.load(spark, d, "embeddings").select(F.lit("v").alias("lang"), F.col("vec_id").alias("pos"), F.col("embedding").alias("emb"))
    top = cone_nearest(own, own, F.lit(True), 4, block=128).filter("i <> j")
    rank = F.row_number().over(Window.partitionBy("i").orderBy("rank"))
    return top.withColumn("rank", rank).filter("rank <= 3").select(F.col("i").alias("q"), F.col("rank").cast("long").alias("rank"), F.col("j").alias("v"), F.round("sim", 6).alias("sim"))


@query(_ERRS + " SELECT round(100.0 * sum(err) FILTER (WHERE n >= 50) / sum(n) FILTER (WHERE n >= 50), 6) AS xsim, count(*) FILTER (WHERE n >= 50) AS pairs, count(*) FILTER (WHERE n < 50) AS skipped FROM errs")
def xsim_micro_avg(spark, d):
    return r.micro_average(r.xsim(fx.emb(spark, d)), 50)


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS emb FROM embeddings), q AS (SELECT 'l' || label AS src, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, emb FROM e WHERE label <> 0 AND vec_id % 9 <> 0),
 t AS (SELECT row_number() OVER (ORDER BY neg, vec_id) - 1 AS j, emb FROM (SELECT vec_id, emb, vec_id % 9 = 0 AS neg FROM e WHERE label = 0 OR vec_id % 9 = 0)),
 s AS (SELECT src, i, j, list_cosine_similarity(q.emb, t.emb) AS sim FROM q, t), b AS (SELECT src, i, j FROM (SELECT *, row_number() OVER (PARTITION BY src, i ORDER BY sim DESC, j) AS rn FROM s) WHERE rn = 1)
 SELECT src, 'l0' AS tgt, count(*) FILTER (WHERE i <> j) AS err, count(*) AS n FROM b GROUP BY src""")
def xsim_pp(spark, d):
    """Other languages against language l0 with hard negatives: every vector whose id is divisible by nine."""
    own = fx.load(spark, d, "embeddings").withColumn("neg", F.col("vec_id") % 9 == 0)
    q = own.filter("label <> 0 and not neg").select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("lang"), F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))
    t = own.filter("label = 0 or neg").select(F.lit("l0").alias("lang"), F.when(F.col("neg"), -F.col("vec_id") - 1).otherwise(F.col("vec_id")).alias("id"), F.col("embedding").alias("emb"))
    return r.xsim(q, t)


@query(_MARGIN.format(score="sim / ((ax + ay) / 2)"))
def xsim_margin_ratio(spark, d):
    return r.xsim(fx.emb(spark, d), margin="ratio")


@query(_MARGIN.format(score="sim - (ax + ay) / 2"))
def xsim_margin_distance(spark, d):
    return r.xsim(fx.emb(spark, d), margin="distance")


_LANGS = [f"l{k}" for k in range(10)]


@query(_ERRS + ", x AS (SELECT src, tgt, round(100.0 * err / n, 6) AS xsim FROM errs) SELECT src, " + ", ".join(f"max(xsim) FILTER (WHERE tgt = '{x}') AS {x}" for x in _LANGS) + " FROM x GROUP BY src")
def xsim_nway(spark, d):
    return r.matrix(r.xsim(fx.emb(spark, d)), _LANGS)


@query(_ERRS + " SELECT src, round(avg(round(100.0 * err / n, 6)), 6) AS avg_xsim FROM errs GROUP BY src")
def xsim_macro_avg(spark, d):
    return r.average_by_source(r.xsim(fx.emb(spark, d)))


@query(_ERRS + " SELECT 'xsim_' || src || '-' || tgt AS metric, round(100.0 * err / n, 6) AS value FROM errs UNION ALL SELECT 'avg_xsim', round(100.0 * sum(err) / sum(n), 6) FROM errs")
def metric_keys(spark, d):

    errs = r.xsim(fx.emb(spark, d))
    named = r.error_rate(errs).select(F.concat(F.lit("xsim_"), "src", F.lit("-"), "tgt").alias("metric"), F.col("xsim").alias("value"))
    return named.unionByName(r.micro_average(errs).select(F.lit("avg_xsim").alias("metric"), F.col("xsim").alias("value")))


@query("""WITH p AS (SELECT a.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z : (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS se, CASE WHEN a.vec_id % 3 = 0 THEN 0 ELSE 1 END AS mask FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
 SELECT round(sum(se * mask) / (count(*) * 64), 9) AS mse, count(*) AS n FROM p""")
def embedding_mse(spark, d):
    own = fx.load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    other = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    both = own.join(other, "vec_id")
    mask = F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1)
    return both.agg(F.round(F.sum(v.squared_error(F.col("a"), F.col("b")) * mask) / (F.count("*") * F.max(F.size("a"))), 9).alias("mse"), F.count("*").alias("n"))


def _sequences(spark, d):
    """Eight token vectors of eight dimensions from each vector; later tokens are masked for some."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i <= F.pmod("vec_id", F.lit(8)), 1).otherwise(0))
    return fx.load(spark, d, "embeddings").select("vec_id", rows.alias("t"), mask.alias("m"))


def _pooled(spark, d, how):
    return _sequences(spark, d).select("vec_id", F.posexplode(v.pool(F.col("t"), F.col("m"), how)).alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value"))


_FLAT = "f AS (SELECT vec_id, (k - 1) % 8 AS dim, (k - 1) // 8 AS tok, embedding[k]::DOUBLE AS x FROM embeddings, range(1, 65) r(k))"


@query(f"WITH {_FLAT} SELECT vec_id, dim, round(avg(x), 6) AS value FROM f WHERE tok <= vec_id % 8 GROUP BY vec_id, dim")
def pool_mean(spark, d):
    return _pooled(spark, d, "mean")


@query(f"WITH {_FLAT} SELECT vec_id, dim, round(max(x), 6) AS value FROM f WHERE tok <= vec_id % 8 GROUP BY vec_id, dim")
def pool_max(spark, d):
    return _pooled(spark, d, "max")


@query(f"WITH {_FLAT} SELECT vec_id, dim, CASE tok WHEN 0 THEN 'cls' ELSE 'last' END AS how, round(x, 6) AS value FROM f WHERE tok IN (0, 7)")
def pool_cls_last(spark, d):
    cls, last = (_pooled(spark, d, h).withColumn("how", F.lit(h)) for h in ("cls", "last"))
    return cls.unionByName(last)
