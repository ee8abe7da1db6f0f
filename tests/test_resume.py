"""Stages that go on file by file."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lingmill.operators.resume import by_file, done, forget, pending


def put(spark, folder, name, low, high):
    spark.range(low, high).withColumn("t", F.concat(F.lit("t"), "id")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/_tmp")
    part = next(p for p in os.listdir(f"{folder}/_tmp") if p.startswith("part-") and p.endswith(".parquet"))
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    os.replace(f"{folder}/_tmp/{part}", f"{folder}/{name}")


def test_the_second_run_reads_new_files_only(spark, tmp_path):
    folder, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), []

    def stage(df):
        seen.append(sorted(os.path.basename(f) for f in df.inputFiles()))
        return df.filter("id % 2 = 0")

    run = lambda: by_file(spark, folder, out, stage)
    ids = lambda: sorted(r.id for r in spark.read.parquet(out).collect())
    put(spark, folder, "a.parquet", 0, 10)
    put(spark, folder, "sub/a.parquet", 100, 110)
    assert run() == 2 and ids() == [*range(0, 10, 2), *range(100, 110, 2)]
    assert run() == 0 and len(seen) == 1
    put(spark, folder, "b.parquet", 20, 24)
    assert run() == 1 and seen[-1] == ["b.parquet"] and ids() == [*range(0, 10, 2), 20, 22, *range(100, 110, 2)]
    assert spark.read.parquet(out).select("file").distinct().count() == 3
    time.sleep(0.05)
    put(spark, folder, "b.parquet", 30, 38)  # replaced: its rows are made anew
    assert run() == 1 and ids() == [*range(0, 10, 2), 30, 32, 34, 36, *range(100, 110, 2)]
    os.remove(f"{folder}/a.parquet")
    assert [os.path.basename(f) for f in forget(spark, folder, out)] == ["a.parquet"]
    assert ids() == [30, 32, 34, 36, *range(100, 110, 2)] and done(spark, out).count() == 2 and run() == 0


def test_a_run_that_fails_does_its_files_again(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, folder, "a.parquet", 0, 4)
    with pytest.raises(Exception, match="lost"):
        by_file(spark, folder, out, lambda df: df.withColumn("x", F.when(F.col("id") == 3, F.raise_error(F.lit("lost")).cast("long"))))
    assert pending(spark, folder, out).count() == 1
    assert by_file(spark, folder, out, lambda df: df.withColumn("x", F.lit(1))) == 1
    assert spark.read.parquet(out).count() == 4 and pending(spark, folder, out).count() == 0
