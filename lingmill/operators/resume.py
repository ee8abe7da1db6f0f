"""Stages that go on file by file: a manifest of what has been done, and one output folder an input file.

The manifest is a table of (file, size, modified, output); a file that has grown or been replaced counts as new. A stage lists its input,
leaves out what the manifest has, reads the other files only, and writes each one's rows to a folder of its own, which a second try replaces. Only
then the files join the manifest: a run that is lost before does the same files again and nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, delete_folder

MANIFEST = "file string, size long, modified timestamp, output string"


def listed(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """file, size, modified, output (the folder of its rows) of the files below a folder. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.concat_ws("-", F.regexp_extract("path", r"([^/]*)$", 1), F.substring(F.md5(F.col("path").cast("binary")), 1, 12)).alias("output"))


def done(spark: SparkSession, out: str) -> DataFrame:
    """The manifest of an output folder; of a file that was done several times, the last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")
    return rows.groupBy("file").agg(F.max_by(F.struct("size", "modified", "output"), "modified").alias("s")).select("file", "s.*")


def pending(spark: SparkSession, folder: str, out: str, pattern: str = "*.parquet") -> DataFrame:
    """Files that the manifest doesn't have as they are now."""
    known = done(spark, out).select("file", "size", "modified")
    return listed(spark, folder, pattern).join(known, ["file", "size", "modified"], "left_anti")


def by_file(spark: SparkSession, folder: str, out: str, stage: Callable[[DataFrame], DataFrame], *, pattern: str = "*.parquet", read: Callable[[list[str]], DataFrame] | None = None) -> int:
    """Runs a stage over the files of a folder that it hasn't done yet, and returns how many those were.

    stage gets the new files' rows with their file as `_file` and keeps that column; a file's rows go to `out/file=<name and digest of its path>`.
    A file whose rows all go has no folder. Outputs of files that are gone stay until `forget`. Only file names come to the driver.
    """
    new = cut(pending(spark, folder, out, pattern))
    names = [r.file for r in new.select("file").collect()]
    if not names:
        return 0
    rows = (read or (lambda files: spark.read.parquet(*files)))(names).withColumn("_file", F.col("_metadata.file_path"))
    made = stage(rows)
    # one row a new file; its name is the folder
    named = made.join(F.broadcast(new.select(F.col("file").alias("_file"), F.col("output").alias("file"))), "_file").drop("_file")
    for r in new.select("output").collect():
        delete_folder(spark, f"{out}/file={r.output}")
    named.write.mode("append").partitionBy("file").parquet(out)
    new.select("file", "size", "modified", "output").coalesce(1).write.mode("append").parquet(f"{out}/_manifest")
    return len(names)


def forget(spark: SparkSession, folder: str, out: str, pattern: str = "*.parquet") -> list[str]:
    """Deletes the outputs of files that are no longer there; returns those files."""
    known = done(spark, out)
    gone = known.join(listed(spark, folder, pattern), "file", "left_anti").collect()
    for r in gone:
        delete_folder(spark, f"{out}/file={r.output}")
    if gone:
        left = cut(known.join(listed(spark, folder, pattern).select("file"), "file", "left_semi"))
        left.coalesce(1).write.mode("overwrite").parquet(f"{out}/_manifest")
    return [r.file for r in gone]
