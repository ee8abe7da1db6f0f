"""Sinks: sharded and partitioned Parquet, CSV, and idempotent publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.folders import write_folder
from .curate import rows_per_shard, shuffled


def exists(df: DataFrame, path: str) -> bool:
    """Whether a finished output stands at path."""
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(target)


def write_shards(df: DataFrame, path: str, *, max_rows: int | None = None, shards: int | None = None, group_rows: int | None = None, overwrite: bool = False) -> bool:
    """Parquet of at most max_rows rows a file, or of about `shards` files, in row groups of at most group_rows.
    False if a finished output was there.

    Spark's committer publishes whole outputs only and drops the files of failed tasks.
    """
    if not overwrite and exists(df, path):
        return False
    if shards:
        max_rows = rows_per_shard(df.count(), shards)
        df = df.repartition(shards)
    w = df.write.mode("overwrite")
    if max_rows:
        w = w.option("maxRecordsPerFile", max_rows)
    if group_rows:
        w = w.option("parquet.block.row.count.limit", group_rows)
    w.parquet(path)
    return True


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """One folder per key value; rows are dealt by key and a salt first, so a hot key fills several files."""
    df.repartition(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, quotes doubled, and white space at either end of a text kept."""
    w = df.write.mode("overwrite").option("header", "true").option("escape", '"')
    w.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def write_arrow(df: DataFrame, path: str) -> None:
    """An Arrow file a task, in a folder that all executors reach under this path or URI.

    Published in two phases: a write that fails leaves the output before it as it was.
    """
    write_folder(df, path, "arrow")


def write_as(df: DataFrame, path: str, kind: str) -> None:
    """csv, json, parquet or arrow."""
    if kind not in ("arrow", "csv", "json", "parquet"):
        raise ValueError(f"no such format: {kind}")
    if kind == "arrow":
        return write_arrow(df, path)
    write_csv(df, path) if kind == "csv" else df.write.mode("overwrite").format(kind).save(path)


def write_shuffled(df: DataFrame, path: str, key: str, seed: int = 42) -> None:
    shuffled(df, key, seed).write.mode("overwrite").parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and an observation that has its row count once an action has run; no second scan."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def memo(df: DataFrame, path: str) -> DataFrame:
    """df from path; written there first if it isn't yet."""
    if not exists(df, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
