"""Views that the registered queries start from, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import number_within
from ..session import load

CODES = {"en": "eng_Latn", "fr": "fra_Latn", "de": "deu_Latn", "es": "spa_Latn"}

_CODE = "CASE lang WHEN 'en' THEN 'eng_Latn' WHEN 'fr' THEN 'fra_Latn' WHEN 'de' THEN 'deu_Latn' WHEN 'es' THEN 'spa_Latn' END"

#: For DuckDB; each needs those before it.
BASE = f"base AS (SELECT doc_id, source, lang, text, {_CODE} AS code, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS pos FROM documents)"
SENTENCES = BASE + ", sentences AS (SELECT doc_id, source, pos AS id, code AS nllb_code, text AS sentence FROM base)"
BITEXT = (
    BASE
    + """, bitext AS (SELECT a.doc_id AS sid, b.doc_id AS tid, a.doc_id || '-' || b.doc_id AS id, a.text AS source_text, b.text AS target_text,
 a.code AS source_nllb_code, b.code AS target_nllb_code,
 CASE WHEN a.doc_id % 7 = 0 THEN NULL ELSE CAST(((a.doc_id * 37) % 100) / 100.0 AS FLOAT) END AS source_lid,
 CASE WHEN b.doc_id % 5 = 0 THEN NULL ELSE CAST(((b.doc_id * 53) % 100) / 100.0 AS FLOAT) END AS target_lid,
 CASE WHEN a.doc_id % 11 = 0 THEN 'und_Zzzz' ELSE a.code END AS source_lid_predicted,
 CASE WHEN b.doc_id % 11 = 0 THEN 'und_Zzzz' ELSE b.code END AS target_lid_predicted
 FROM base a JOIN base b ON a.source = b.source AND a.pos = b.pos AND a.lang < b.lang)"""
)
FACTORS = """, totals AS (SELECT code, sum(length(text)) AS total FROM base GROUP BY code),
 factors AS (SELECT code AS nllb_code, (SELECT total FROM totals WHERE code = 'eng_Latn')::DOUBLE / total AS correction_ratio FROM totals)"""
FEATURES = (
    BITEXT
    + FACTORS
    + """, features AS (SELECT bitext.*, length(source_text) AS sl, length(target_text) AS tl, coalesce(fs.correction_ratio, 1.0) AS sr, coalesce(ft.correction_ratio, 1.0) AS tr,
 length(source_text) * coalesce(fs.correction_ratio, 1.0) AS sc, length(target_text) * coalesce(ft.correction_ratio, 1.0) AS tc
 FROM bitext LEFT JOIN factors fs ON fs.nllb_code = source_nllb_code LEFT JOIN factors ft ON ft.nllb_code = target_nllb_code),
 kept AS (SELECT * FROM features WHERE sl >= 15 AND tl >= 15 AND greatest(sc, tc) / nullif(least(sc, tc), 0) <= 4.0)"""
)
#: The normalised key; the classes are Unicode's.
KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\s]', '', 'g'), '[\x00-\x1F\x7F]', '', 'g'), '\p{{Nd}}', '', 'g'), '\s+', ' ', 'g'))"
EMB = "emb AS (SELECT 'l' || label AS lang, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding::DOUBLE[] AS emb, vec_id, label FROM embeddings)"
SEED = BASE + ", seed AS (SELECT row_number() OVER (PARTITION BY code ORDER BY doc_id) AS id, text, 'doc/' || doc_id AS url, code AS nllb_code FROM base)"
TOKENS = "tokens AS (SELECT doc_id AS id, list_transform(string_split(text, ' '), lambda w : length(w) + 10)::INTEGER[] AS ids, n_chars FROM documents)"
PREDICTIONS = BITEXT + r""", predictions AS (SELECT id, source_nllb_code AS source_langs, target_nllb_code AS target_langs, source_text AS inputs, target_text AS labels,
 array_to_string(list_filter(string_split(target_text, ' '), lambda w, i : i % 5 <> 0), ' ') AS preds FROM bitext)"""


def base(spark: SparkSession, d: str) -> DataFrame:
    """documents with their code and their position within source and language.

    Positions are numbered within (source, lang); the widest view that is a fixture's own, not an operator's.
    """
    code = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in CODES.items()])
    pos = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    return load(spark, d, "documents").select("doc_id", "source", "lang", "text", code.alias("code"), pos.alias("pos"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).select("doc_id", "source", F.col("pos").cast("long").alias("id"), F.col("code").alias("nllb_code"), F.col("text").alias("sentence"))


def bitext(spark: SparkSession, d: str) -> DataFrame:
    own = base(spark, d)
    side = lambda p: own.select(*[F.col(c).alias(f"{p}_{c}") for c in own.columns])
    a, b = side("source"), side("target")
    rows = a.join(b, (F.col("source_source") == F.col("target_source")) & (F.col("source_pos") == F.col("target_pos")) & (F.col("source_lang") < F.col("target_lang")))
    score = lambda c, m, k: F.when(F.col(c) % m != 0, ((F.col(c) * k) % 100 / F.lit(100.0)).cast("float"))
    said = lambda p: F.when(F.col(f"{p}_doc_id") % 11 == 0, "und_Zzzz").otherwise(F.col(f"{p}_code"))
    return rows.select(
        F.col("source_doc_id").alias("sid"), F.col("target_doc_id").alias("tid"), F.concat("source_doc_id", F.lit("-"), "target_doc_id").alias("id"),
        "source_text", "target_text", F.col("source_code").alias("source_nllb_code"), F.col("target_code").alias("target_nllb_code"),
        score("source_doc_id", 7, 37).alias("source_lid"), score("target_doc_id", 5, 53).alias("target_lid"),
        said("source").alias("source_lid_predicted"), said("target").alias("target_lid_predicted"),
    )


def emb(spark: SparkSession, d: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return load(spark, d, "embeddings").select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("lang"), pos.cast("long").alias("id"), F.col("embedding").alias("emb"), "vec_id", "label")


def seed(spark: SparkSession, d: str) -> DataFrame:
    own = number_within(base(spark, d).select("doc_id", "text", "code"), ["code"], ["doc_id"], "number")  # a language has a quarter of all texts
    return own.select((F.col("number") + 1).alias("id"), "text", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), F.col("code").alias("nllb_code"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """All words of each text as token ids."""
    return load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.transform(F.split("text", " "), lambda w: F.length(w) + 10).alias("ids"), "n_chars")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    kept = F.array_join(F.filter(F.split("target_text", " "), lambda w, i: (i + 1) % 5 != 0), " ")
    return bitext(spark, d).select("id", F.col("source_nllb_code").alias("source_langs"), F.col("target_nllb_code").alias("target_langs"), F.col("source_text").alias("inputs"), F.col("target_text").alias("labels"), kept.alias("preds"))
