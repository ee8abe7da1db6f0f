"""A training corpus from `documents`: toxic documents go, near duplicates go, sources are mixed, sequences are packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents. Rows
may repeat, and doc_id and text may be null: a null doc_id is a document that no other
duplicates by id, a null text is an empty one. An empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingmill.llm.common import cut, ensure_checkpoint_dir, table, text_of, unused_names
from lingmill.llm.minhash import near_duplicates
from lingmill.llm.mixing import mixed_documents
from lingmill.llm.packing import packing_query
from lingmill.llm.toxicity import fit, scorer
from lingmill.session import delete_folder

TOXIC_AT = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.3."""
    score = scorer(fit(docs, table(spark, sf_dir, "labels")))
    return docs.filter(score(text_of()) < TOXIC_AT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, once.

    Of rows that share this doc_id the one with the least text stays; null doc_ids all stay.
    """
    found = cut(near_duplicates(docs))
    of, n, kept, row = unused_names(docs, "of", "n", "kept", "row")
    ids = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias(of)).agg(F.count("*").alias(n), F.min("kept").alias(kept))
    # what goes is the smaller side; it is broadcast only if Spark measures it as small
    other = cut(ids.filter((F.col(n) > 1) | ~F.col(kept)))
    same = F.col("doc_id") == F.col(of)
    single = docs.join(other, same, "left_anti")
    again = docs.join(other.filter(F.col(kept)), same, "left_semi")
    # a minimum runs before the shuffle, however many rows share the id
    first = again.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col("text").isNull(), "text")).alias(row))
    return single.unionByName(first.select(*[F.col(row).getField(c).alias(c) for c in docs.columns]))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece."""
    import public_tokenizers

    return packing_query(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Near-duplicate components and a trained classifier have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again, and goes once the next one is written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{name}"
    out = cut(STAGES[-1][1](spark, docs, sf_dir))
    delete_folder(spark, folder)
    return out
