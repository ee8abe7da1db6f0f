import pytest
from pyspark.sql import functions as F

from lingmill.operators.permute import Permutation, numbered, permuted, window_of, written_order


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 99, 100, 101, 225, 226, 1000, 4099])
def test_bijection_of_numbers_and_columns(spark, n):
    p = Permutation(n, 7, 3)
    want = [p.place_of(i) for i in range(n)]
    assert sorted(want) == list(range(n)) and [p.row_at(x) for x in want] == list(range(n))
    if n in (1, 3, 101, 4099):
        got = spark.range(n).select("id", p.places(F.col("id")).alias("p")).withColumn("back", p.rows(F.col("p"))).collect()
        assert {r.id: r.p for r in got} == dict(enumerate(want)) and all(r.back == r.id for r in got)


def test_epochs_and_seeds_differ_and_look_random():
    n = 5000
    orders = [[Permutation(n, s, e).place_of(i) for i in range(n)] for s, e in ((1, 0), (1, 1), (2, 0))]
    for a in orders:
        assert sum(a[i + 1] > a[i] for i in range(n - 1)) / n == pytest.approx(0.5, abs=0.03)
        assert abs(sum((x - n / 2) * (i - n / 2) for i, x in enumerate(a)) / (n**3 / 12)) < 0.06
        for b in orders:
            if a is not b:
                assert sum(x == y for x, y in zip(a, b)) < 10


def test_large_tables(spark):
    p = Permutation((1 << 52) - 1, 5)
    for i in (0, 1, 12345678901, (1 << 52) - 2):
        assert p.row_at(p.place_of(i)) == i
    got = spark.createDataFrame([(i,) for i in (0, 1, 12345678901, (1 << 52) - 2)], "i long").select("i", p.places(F.col("i")).alias("p")).collect()
    assert all(r.p == p.place_of(r.i) for r in got)
    with pytest.raises(ValueError):
        Permutation(1 << 52)
    with pytest.raises(ValueError):
        Permutation(3).place_of(3)


def test_batches_by_place(spark):
    rows, n = numbered(spark.range(1000, 1500).select((F.col("id") * 3 % 500).alias("k"), F.col("id").cast("string").alias("t")), ["k"])
    every = sorted(permuted(rows, n, epoch=2).collect(), key=lambda r: r.place)
    assert [r.place for r in every] == list(range(500)) and {r.k for r in every} == set(range(500))
    batches = [sorted(window_of(rows, n, at, at + 64, epoch=2).collect(), key=lambda r: r.place) for at in range(0, 500, 64)]
    assert [(r.place, r.k) for b in batches for r in b] == [(r.place, r.k) for r in every]
    assert "Exchange" not in permuted(spark.range(10), 10, "id")._jdf.queryExecution().executedPlan().toString()
    assert permuted(spark.range(3).select(F.lit(None).cast("long").alias("row")), 3).filter("place is null").count() == 3


def test_written_in_order(spark, tmp_path):
    rows, n = numbered(spark.range(300), ["id"])
    written_order(rows, n, str(tmp_path / "o"), 4, epoch=1)
    files = sorted((tmp_path / "o").glob("part-*"))
    got = [r.place for f in files for r in spark.read.parquet(str(f)).collect()]
    assert got == list(range(300)) and len(files) == 4
