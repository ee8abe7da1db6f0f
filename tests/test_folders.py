"""Two-phase publishing of Arrow folders."""

import pytest
from pyspark.sql import functions as F

from lingmill.operators import sinks
from lingmill.sources import readers
from lingmill.sources.folders import write_folder


def left(tmp_path):
    return sorted(p.name for p in tmp_path.iterdir())


def test_a_failed_overwrite_leaves_the_old_output(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_arrow(spark.range(0, 100, 1, 3), path)
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    # some tasks write whole files before another one fails
    broken = spark.range(0, 100, 1, 4).withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_arrow(broken, path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == before and left(tmp_path) == ["out"]
    assert readers.arrow(spark, path).count() == 100
    sinks.write_arrow(spark.range(7), path)
    assert sorted(r.id for r in readers.arrow(spark, path).collect()) == list(range(7)) and left(tmp_path) == ["out"]
    assert (tmp_path / "out/_SUCCESS").exists()


def test_append_and_empty(spark, tmp_path):
    path = str(tmp_path / "out")
    write_folder(spark.range(0, 10, 1, 2), path, append=True)
    write_folder(spark.range(10, 15, 1, 1), path, append=True)
    assert sorted(r.id for r in readers.arrow(spark, path).collect()) == list(range(15))
    write_folder(spark.range(0), path)
    assert readers.arrow(spark, path).count() == 0 and left(tmp_path) == ["out"]
    with pytest.raises(Exception, match="no such kind"):
        write_folder(spark.range(1), path, "avro")


def test_a_lost_driver_is_made_good(spark, tmp_path):
    """Between the two renames the old folder stands aside; the next write puts it back before its own commit."""
    path = str(tmp_path / "out")
    write_folder(spark.range(5), path)
    (tmp_path / "out").rename(tmp_path / "out._old-abc")
    write_folder(spark.range(3), path, append=True)
    assert readers.arrow(spark, path).count() == 8 and left(tmp_path) == ["out"]
