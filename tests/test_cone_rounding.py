import numpy as np
from pyspark.sql import functions as F

from lingmill.operators import retrieval as r


def table(spark, lang, x):
    return spark.createDataFrame([(lang, i, v.tolist()) for i, v in enumerate(x)], "lang string, pos long, emb array<double>")


def test_cells_narrower_than_a_cosine_tells_are_looked_at(spark):
    """The best target is 6e-9 from copies that are less similar than another cell; the cosine of that angle is 1 in double precision."""
    y = np.zeros((20, 3))
    y[:10, 1] = 1
    y[4, 0] = 6e-9
    y[10:] = [3e-9, 0, 1]
    got = r.nearest(table(spark, "a", np.eye(1, 3)), table(spark, "b", y), F.lit(True), 1, block=10)
    assert [(v.i, v.j) for v in got.collect()] == [(0, 4)]
