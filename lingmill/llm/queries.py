"""Contract queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no words, no places and score 0; every row of documents gives a row; an empty table gives an empty one."""
    from .licenses import licenses_query

    return licenses_query(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and roles are empty, rows of a null conv_id are one conversation; should the table hold a conversation -7, its turns and the added ones are one conversation."""
    from .chat import chat_query

    return chat_query(table(spark, sf_dir, "conversations"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text is its closing id alone; every row of documents is packed, repeated ones too; an empty table gives an empty one."""
    from .packing import packing_query

    return packing_query(table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts get the score of a text without words; every row of documents gives a row; without usable labels the list of insults decides."""
    from .toxicity import toxicity_query

    return toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and texts without words have an empty set and stand alone; rows of one doc_id share a component; a null doc_id has none and is kept."""
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no tokens; every row of documents gives a row; a text of any length is counted whole."""
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _path("piece_bpe_32k.model"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have size 0, a null source is a source of its own, the last; repeated rows are documents of their own; an empty table gives an empty one."""
    from .mixing import mixing_query

    return mixing_query(table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors null, zero or holding null or non-finite components take no part; fewer candidates than ten give them all."""
    from .ann import ann_query

    return ann_query(table(spark, sf_dir, "embeddings"))


def op9_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors null, zero or holding null or non-finite components link with nothing and are kept, as are those of a null vec_id."""
    from .graph_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null doc_ids share a shard, null texts have no bytes, repeated rows keep their own slots; an empty table gives an empty one."""
    from .sharding import sharding_query

    return sharding_query(table(spark, sf_dir, "documents"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors null or holding null or non-finite components take no part; an empty table gives an empty one."""
    from .topk import topk_query

    return topk_query(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null roles and texts are empty, rows of a null conv_id take no part; an empty table gives an empty one."""
    from .trie import trie_query

    return trie_query(table(spark, sf_dir, "conversations"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have no words; every row of documents gives a row; an empty table gives an empty one."""
    from .runs import runs_query

    return runs_query(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_licenses, op2_chat, op3_packing, op4_toxicity, op5_minhash, op6_token_counts, op7_mixing, op8_ann, op9_graph_dedup, op10_sharding, op11_topk, op12_prefix_trie, op13_runs)}
