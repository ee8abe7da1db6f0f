"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from . import fixtures as fx
from .registry import query

_WORDS = r"list_filter(string_split_regex(trim({c}, e' \n\t\r'), '\s+'), lambda w : w <> '')"
_GRAMS = " UNION ALL ".join(
    f"SELECT id, source_langs, target_langs, {n} AS n, h, r, array_to_string(w[k:k + {n - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {n - 2})) AS k FROM sides)" for n in range(1, 5)
)
_LOG = " + ".join(f"ln(CASE WHEN m{k} > 0 THEN m{k}::DOUBLE ELSE pow(2.0, -({' + '.join(f'(m{j} = 0)::INT' for j in range(1, k + 1))})) END / greatest(t{k}, 1))" for k in range(1, 5))
_BLEU = (
    f"WITH {fx.PREDICTIONS}, sides AS (SELECT id, source_langs, target_langs, 1 AS h, 0 AS r, {_WORDS.format(c='preds')} AS w FROM predictions UNION ALL SELECT id, source_langs, target_langs, 0, 1, {_WORDS.format(c='labels')} FROM predictions),"
    f" grams AS ({_GRAMS}), cnt AS (SELECT id, source_langs, target_langs, n, g, sum(h) AS h, sum(r) AS r FROM grams GROUP BY ALL),"
    " st AS (SELECT source_langs, target_langs, "
    + ", ".join(f"coalesce(sum(least(h, r)) FILTER (WHERE n = {k}), 0) AS m{k}, coalesce(sum(h) FILTER (WHERE n = {k}), 0) AS t{k}" for k in range(1, 5))
    + " FROM cnt GROUP BY source_langs, target_langs), ln AS (SELECT source_langs, target_langs, sum(len(w)) FILTER (WHERE h = 1)::DOUBLE AS hl, sum(len(w)) FILTER (WHERE r = 1)::DOUBLE AS rl FROM sides GROUP BY source_langs, target_langs),"
    f" bleu AS (SELECT source_langs, target_langs, round(CASE WHEN m1 > 0 AND t4 > 0 THEN 100 * CASE WHEN hl >= rl THEN 1.0 ELSE exp(1 - rl / hl) END * exp(({_LOG}) / 4) ELSE 0.0 END, 6) AS bleu, hl::BIGINT AS hyp_len, rl::BIGINT AS ref_len FROM st JOIN ln USING (source_langs, target_langs))"
)


@query(_BLEU + " SELECT * FROM bleu")
def bleu_by_pair(spark, d):
    return m.corpus_bleu(fx.predictions(spark, d), ["source_langs", "target_langs"])


@query(_BLEU + " SELECT round(avg(bleu), 6) AS avg_all, round(avg(bleu) FILTER (WHERE target_langs = 'eng_Latn' AND source_langs <> 'eng_Latn'), 6) AS avg_to_pivot, round(avg(bleu) FILTER (WHERE source_langs = 'eng_Latn' AND target_langs <> 'eng_Latn'), 6) AS avg_from_pivot, round(avg(bleu) FILTER (WHERE source_langs = target_langs), 6) AS avg_identity FROM bleu")
def bleu_subset_means(spark, d):
    return m.subset_means(bleu_by_pair(spark, d), "bleu")


@query()
def wer(spark, d):
    """Word error rate of next turns against turns, per role."""
    own = fx.load(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("labels"))
    preds = own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("labels").alias("preds"))
    return m.word_error_rate(own.join(preds, ["conv_id", "turn"]), ["role"])


_SCHEDULE = "CASE WHEN i < 40 THEN 0.001 + 0.999 * i / 40.0 ELSE 1 / sqrt((i + {shift}) / {scale}) END"


@query(f"SELECT i::BIGINT AS step, round({_SCHEDULE.format(shift=0, scale=40.0)}, 9) AS factor FROM range(400) t(i)")
def inv_sqrt_lr(spark, d):
    return m.inverse_sqrt_schedule(spark, 400, warmup=40)


@query(f"""SELECT name, i::BIGINT AS step, round(CASE WHEN name = 'specific' THEN 1 / sqrt((i + 20) / 20.0) ELSE {_SCHEDULE.format(shift=0, scale=40.0)} END, 9) AS factor
 FROM range(400) t(i), (VALUES ('shared'), ('other'), ('specific')) g(name)""")
def grouped_lr(spark, d):
    return m.grouped_schedules(spark, 400, warmup=40)


@query("""WITH RECURSIVE p AS (SELECT 0 AS k, exp(-3.0) AS p UNION ALL SELECT k + 1, p * 3.0 / (k + 1) FROM p WHERE k < 127) SELECT k, round(p, 12) AS p FROM p WHERE round(p, 12) >= 1e-7 OR k <= 3""")
def poisson_pmf(spark, d):
    return m.poisson_pmf(spark)


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v : v::DOUBLE) AS l, CASE WHEN vec_id % 9 = 0 THEN -100 ELSE vec_id % len(embedding) END AS y FROM embeddings),
 t AS (SELECT *, ln(list_sum(list_transform(l, lambda v : exp(v)))) AS z FROM x)
 SELECT vec_id, round(0.9 * (z - l[y + 1]) + 0.1 * (z - list_sum(l) / len(l)), 6) AS loss FROM t WHERE y <> -100""")
def label_smoothed_ce(spark, d):
    y = F.when(F.col("vec_id") % 9 == 0, -100).otherwise(F.col("vec_id") % F.size("embedding"))
    loss = m.smoothed_cross_entropy(F.col("embedding"), y)
    return fx.load(spark, d, "embeddings").select("vec_id", F.round(loss, 6).alias("loss")).filter("loss is not null")


@query(f"WITH {fx.PREDICTIONS} SELECT source_langs, target_langs, count(*) AS n FROM (SELECT DISTINCT source_langs, target_langs, inputs FROM predictions) GROUP BY ALL")
def predictions_dedup(spark, d):
    from ..operators.curate import drop_duplicates_first

    own = drop_duplicates_first(fx.predictions(spark, d), ["source_langs", "target_langs", "inputs"], ["id"])
    return own.groupBy("source_langs", "target_langs").agg(F.count("*").alias("n"))
