import pytest
from pyspark.sql import functions as F

from lingmill.operators.ordering import number_within
from lingmill.operators.pairing import frequent
from lingmill.plans import fixtures as fx

SF = "/root/testdata/sf0.01"


@pytest.fixture
def dealt(spark):
    """Every join that isn't asked to be broadcast deals its rows by key, as with large tables."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def most(df):
    """Rows of the fullest partition."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_no_task_has_a_whole_language(spark, dealt):
    seed = fx.seed(spark, SF)
    whole = seed.groupBy("nllb_code").count().agg(F.max("count")).first()[0]
    assert most(seed) < 0.9 * whole
    assert most(frequent(seed, "nllb_code", 110)) < 0.9 * whole


def test_numbers_go_on_within_a_language(spark):
    rows = fx.seed(spark, SF).groupBy("nllb_code").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count_distinct("id").alias("n"), F.count("*").alias("m")).collect()
    assert all((r.a, r.b, r.n) == (1, r.m, r.m) for r in rows)


def test_a_group_stays_dealt(spark, dealt):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    own = number_within(df, ["g"], ["x"], "n")
    assert most(own) < 500
    assert own.filter("n != (x - g) / 2").count() == 0
