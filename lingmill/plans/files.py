"""Queries over files: whole tables are written in a format, read back by its reader, and compared with what they were."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import one_line
from ..operators import resume, sinks
from ..operators.ordering import number_rows, number_within
from ..session import cut, delete_folder, ensure_checkpoint_dir
from ..sources import readers
from . import fixtures as fx
from .registry import query


def _through(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What read makes of what write has put in a folder that all executors share; the folder goes."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    write(f"{folder}/out")
    out = cut(read(f"{folder}/out"))
    delete_folder(spark, folder)
    return out


@query("SELECT doc_id, lang, text FROM documents")
def csv_files(spark, d):
    """Quoted CSV whose texts hold line ends, read in splits."""
    docs = fx.load(spark, d, "documents").select("doc_id", "lang", "text")
    back = _through(spark, lambda p: sinks.write_csv(docs, p), lambda p: readers.split_csv(spark, p, columns=["doc_id", "lang", "text"])[0])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")


@query("SELECT conv_id, turn, role, text FROM conversations")
def tsv_files(spark, d):
    """Quoted TSV without a header."""
    turns = fx.load(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    write = lambda p: turns.write.option("sep", "\t").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(p)
    back = _through(spark, write, lambda p: readers.split_csv(spark, p, sep="\t", header=False, columns=turns.columns)[0])
    return back.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x : x::DOUBLE)), 6) AS total, len(embedding)::INT AS n FROM embeddings")
def arrow_files(spark, d):
    """Arrow files, published in two phases."""
    own = fx.load(spark, d, "embeddings").select("vec_id", "label", "embedding")
    back = _through(spark, lambda p: sinks.write_arrow(own, p), lambda p: readers.arrow(spark, p))
    return back.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"), F.size("embedding").alias("n"))


@query(r"SELECT doc_id::VARCHAR AS source_text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS target_text FROM documents WHERE text IS NOT NULL")
def block_files(spark, d):
    """Marker blocks in text files, read in splits."""
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    lines = fx.load(spark, d, "documents").filter("text is not null").select(F.concat(F.lit("ID: "), "doc_id", F.lit("\nBODY: "), body).alias("value"))
    return _through(spark, lambda p: lines.write.text(p), lambda p: readers.marked_block_files(spark, p, first="ID", second="BODY"))


@query("SELECT doc_id, length(text)::INT AS n FROM documents WHERE lang = 'fr'")
def resumed_files(spark, d):
    """A stage that goes on file by file: shards of documents, a third of them done in a first run, the rest in a second one."""
    docs = fx.load(spark, d, "documents").select("doc_id", "lang", "text")
    stage = lambda df: df.filter("lang = 'fr'").select("doc_id", F.length("text").alias("n"), "_file")

    def write(p: str) -> None:
        shards = docs.withColumn("shard", F.pmod(F.col("doc_id"), F.lit(3)))
        shards.filter("shard = 0").drop("shard").write.parquet(f"{p}/in/first")
        resume.by_file(spark, f"{p}/in", f"{p}/done", stage)
        shards.filter("shard <> 0").drop("shard").write.parquet(f"{p}/in/second")
        resume.by_file(spark, f"{p}/in", f"{p}/done", stage)

    return _through(spark, write, lambda p: spark.read.parquet(f"{p}/done").select("doc_id", "n"))


@query("SELECT count(*) AS n_rows, max(doc_id) AS last, true AS within FROM documents")
def shard_files(spark, d):
    """Parquet files of at most 300 rows each."""
    docs = fx.load(spark, d, "documents").select("doc_id", "text")

    def read(p: str) -> DataFrame:
        per = spark.read.parquet(p).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        return per.agg(F.sum("n").alias("n_rows"), F.max("last").alias("last"), (F.max("n") <= 300).alias("within"))

    return _through(spark, lambda p: sinks.write_shards(docs, p, max_rows=300), read)


@query(f"WITH {fx.BITEXT} SELECT row_number() OVER (ORDER BY sid, tid) - 1 AS line, replace(source_text, chr(10), ' ') AS source_text, replace(target_text, chr(10), ' ') AS target_text FROM bitext")
def line_pair_files(spark, d):
    """Two line-aligned folders of text files, read in splits and zipped by line."""
    # pairs are made and numbered without texts; a key, and a number among rows of one key, stand for a row
    key, alike = F.xxhash64("doc_id", "source", "lang", "text").alias("key"), Window.partitionBy("key").orderBy("doc_id", "source", "lang")
    named = lambda df, *more: df.select("doc_id", "source", "lang", key, *more).withColumn("copy", F.row_number().over(alike))
    docs = fx.load(spark, d, "documents")
    own = number_within(named(docs), ["source", "lang"], ["doc_id", "key"], "pos").withColumn("row", F.struct("key", "copy"))
    a, b = (own.select("source", "pos", F.col("doc_id").alias(f"{p}id"), F.col("lang").alias(f"{p}_lang"), F.col("row").alias(f"{p}_row")) for p in "st")
    pairs = number_rows(a.join(b, ["source", "pos"]).filter("s_lang < t_lang"), ["sid", "tid"], "line")
    ends = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), f"{side[0]}_row.key", f"{side[0]}_row.copy") for side in ("source", "target")]))
    wanted = pairs.select("line", ends.alias("end")).select("line", "end.side", F.col("end.key").alias("of"), F.col("end.copy").alias("nth"))
    texts = named(docs, one_line(F.col("text")).alias("value"))
    # joined by the key alone, by which texts are dealt already
    lines = wanted.join(texts, (F.col("of") == F.col("key")) & (F.col("nth") - F.col("copy") == 0)).orderBy("side", "line").select("side", "value")

    def write(p: str) -> None:
        lines.write.partitionBy("side").text(p)
        for side in ("source", "target"):  # without pairs there would be no folder
            spark.createDataFrame([], "value string").write.mode("append").text(f"{p}/side={side}")

    back = _through(spark, write, lambda p: readers.text_pair(spark, f"{p}/side=source", f"{p}/side=target", "eng_Latn", "fra_Latn"))
    return back.select("line", "source_text", "target_text")


@query(f"""WITH {fx.BITEXT} SELECT trim(regexp_replace(source_text, '\\s+', ' ', 'g')) AS source_text, trim(regexp_replace(target_text, '\\s+', ' ', 'g')) AS target_text FROM bitext""")
def tmx_files(spark, d):
    """A translation memory as XML, read by its units."""
    text = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    variant = lambda lang, c: F.struct(F.lit(lang).alias("_lang"), text(F.col(c)).alias("seg"))
    units = fx.bitext(spark, d).select(F.array(variant("en", "source_text"), variant("fr", "target_text")).alias("tuv"))
    return _through(spark, lambda p: units.write.format("xml").option("rootTag", "body").option("rowTag", "tu").save(p), lambda p: readers.tmx(spark, p, "en", "fr"))


@query("SELECT -row_number() OVER (ORDER BY item_id) AS id, replace(text, chr(10), ' ') AS sentence, 'eng_Latn' AS nllb_code FROM benchmark")
def negative_files(spark, d):
    """Headless files of one column as hard negatives, numbered downwards over all splits."""
    rows = fx.load(spark, d, "benchmark").select("item_id", one_line(F.col("text")).alias("value")).orderBy("item_id")
    return _through(spark, lambda p: rows.select("value").write.text(p), lambda p: readers.negatives(spark, p, "eng_Latn"))
