"""Session helpers."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Seconds between two requests to the collectors.
COLLECT_EVERY = 5.0
_collected = 0.0


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per Spark context.

    Spark's own file server carries it, so executors need no shared folder and no install.
    """
    context = spark.sparkContext
    if getattr(context, "_lingmill_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lingmill-"), "lingmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lingmill", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._lingmill_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only where it is unset, with a local master as in tests, take a temporary one."""
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            path = tempfile.mkdtemp(prefix="lingmill-ckpt-")
        spark.sparkContext.setCheckpointDir(path)


@contextmanager
def compiled(spark: SparkSession, fields: int, most: int = 200) -> Iterator[None]:
    """What is materialised inside is compiled as whole stages though its rows have so many fields more than Spark's own bound allows. With more than `most` of
    them the bound stays, since the JVM does not compile methods of that length."""
    key = "spark.sql.codegen.maxFields"
    before = spark.conf.get(key)
    if fields <= most:
        spark.conf.set(key, str(max(int(before), fields + 50)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage.

    Shuffle files and checkpoints of earlier rounds go once the driver's collector has found
    their plans unused; rounds make too little garbage for it to run by itself, so it is asked to, every few seconds at most.
    """
    global _collected
    ensure_checkpoint_dir(df.sparkSession)
    out = _bounded(df.checkpoint(eager=True))
    if time.monotonic() - _collected > COLLECT_EVERY:
        gc.collect()
        df.sparkSession._jvm.System.gc()
        _collected = time.monotonic()
    return out


def _bounded(df: DataFrame) -> DataFrame:
    """df without its size estimate, where that has outgrown 62 bits.

    A checkpoint keeps the estimate of its plan, and a join's is the product of its sides': in a loop
    of joins the number of its digits doubles with every round, until planning does nothing but multiply.
    """
    plan = df._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes().bit_length() <= 62:
        return df
    return type(df)(df.sparkSession._jsparkSession.internalCreateDataFrame(plan.toRdd(), df._jdf.schema(), False), df.sparkSession)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
