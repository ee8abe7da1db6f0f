import random

from lingmill.operators import stats


def test_equal_to_percentile_disc(spark):
    r = random.Random(4)
    rows = [("a", r.gauss(0, 1)) for _ in range(3000)] + [("hot", 5.0) for _ in range(4000)] + [("hot", float(i)) for i in range(500)] + [("b", None), ("one", -2.5)]
    rows += [("wide", x) for x in (1e308, -1e308, 0.0, 1e-300, 7.0)] + [(None, 1.0), (None, 3.0)] + [("steps", float(r.randint(0, 3))) for _ in range(101)]
    df = spark.createDataFrame(rows, "nllb_code string, value double").repartition(5)
    points = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = {(x.nllb_code, x.point): x.quantile for x in stats.quantiles(df, "nllb_code", "value", points, bins=16).collect()}
    for g in {k for k, _ in rows}:
        own = sorted(v for k, v in rows if k == g and v is not None)
        for p in points:
            want = next((v for i, v in enumerate(own, 1) if i / len(own) >= p), None)
            assert got[g, p] == want, (g, p)


def test_describe_by_rounds_equals_exact(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(r.choice("xyz"), r.choice([None, float(r.randint(0, 1000))])) for _ in range(2000)], "nllb_code string, value double")
    assert sorted(map(tuple, stats.describe(df, method="rounds").collect())) == sorted(map(tuple, stats.describe(df).collect()))
    assert stats.describe(df.limit(0), method="rounds").count() == 0
