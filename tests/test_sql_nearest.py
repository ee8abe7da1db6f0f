import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingmill.operators import retrieval as r
from lingmill.operators.meeting import unit


def table(spark, lang, x):
    return spark.createDataFrame([(lang, i, v.tolist()) for i, v in enumerate(x)], "lang string, pos long, emb array<double>")


@pytest.mark.parametrize("k", [1, 3, 12])
def test_best_of_blocks(spark, k):
    """Ties across blocks go to the smaller position; the last block is not full, and there may be fewer blocks than k."""
    g = np.random.default_rng(4)
    x, y = g.standard_normal((50, 8)), g.standard_normal((150, 8))
    y[20:90] = y[20]  # copies in several blocks
    x[:10], y[7], x[11] = y[20], 0, 0
    sims = unit(x) @ unit(y).T
    sims[:, 20:90] = sims[:, 20:21]
    want = {(i, int(j), n + 1) for i, row in enumerate(sims) for n, j in enumerate(np.lexsort((np.arange(150), -row))[:k])}
    got = r.sql_nearest(table(spark, "a", x), table(spark, "b", y), F.lit(True), k, block=16)
    assert {(v.i, v.j, v.rank) for v in got.collect()} == want


def test_vectors_without_components_come_last(spark):
    rows = [("b", 0, None), ("b", 1, [1.0, None]), ("b", 2, [-1.0, -1.0]), ("b", 3, [1.0]), ("a", 0, [1.0, 1.0]), ("a", 1, None)]
    own = spark.createDataFrame(rows, "lang string, pos long, emb array<double>")
    got = r.sql_nearest(own, own, F.expr("src = 'a' and tgt = 'b'"), 1, block=2)
    assert {(v.i, v.j) for v in got.collect()} == {(0, 2), (1, 0)}


def test_products_are_compiled(spark):
    """50 million products of 64 dimensions; in a lambda, each takes some 6 microseconds of a core."""
    g = np.random.default_rng(5)
    x, y = g.standard_normal((5000, 64)), g.standard_normal((10_000, 64))
    q, t = table(spark, "a", x).cache(), table(spark, "b", y).cache()
    assert (q.count(), t.count()) == (5000, 10_000)
    before, fields = time.monotonic(), spark.conf.get("spark.sql.codegen.maxFields")
    got = dict(r.sql_nearest(q, t, F.lit(True), 1).select("i", "j").collect())
    assert time.monotonic() - before < 40
    assert got == dict(enumerate((unit(x) @ unit(y).T).argmax(1).tolist()))
    assert spark.conf.get("spark.sql.codegen.maxFields") == fields
