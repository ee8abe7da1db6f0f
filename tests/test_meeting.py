import numpy as np
import pytest
from pyspark.sql import functions as F

from lingmill.operators import retrieval as r
from lingmill.operators.cones import cone_nearest
from lingmill.operators.meeting import best, sides, unit


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def brute(q, t, place, k):
    sims = np.round(q @ t.T, 12)
    return [[(int(place[j]), sims[i, j]) for j in np.lexsort((place, -sims[i]))[:k]] for i in range(len(q))]


@pytest.mark.parametrize("k", [1, 4, 700])
def test_best_is_that_of_double_precision(k):
    g = np.random.default_rng(3)
    q, t = unit(g.standard_normal((60, 16))), unit(g.standard_normal((600, 16)))
    t[50:350] = t[50]  # a hot group of copies
    t[400] = unit(t[401:402] + 1e-9)[0]  # nearer than single precision tells
    q[:20], q[20], t[9] = t[50], t[401], 0
    place = g.permutation(600)
    at, of, sims = best(q, t, place, k)
    for i in range(len(q)):
        own = at == i
        want = brute(q[i : i + 1], t, place, k)[0]
        assert [(int(p)) for p in place[of[own]]] == [p for p, _ in want]
        assert np.allclose(sims[own], [s for _, s in want], atol=1e-11)


def test_copies_do_not_grow_with_the_rows():
    assert sum(sides(100_000, 100_000, 131_072)) == sum(sides(800_000, 800_000, 131_072)) <= 16
    assert sides(0, 10, 5) == (1, 2)
    assert max(sides(10**6, 10**6, 10_000)) == 100  # a block bounds a task's memory


def table(spark, lang, x):
    return spark.createDataFrame([(lang, i, v.tolist()) for i, v in enumerate(x)], "lang string, pos long, emb array<double>")


def test_cells_share_what_is_shuffled(spark):
    """Vectors without clusters, whose cones rule nothing out: every cell visits every other."""
    x = np.random.default_rng(1).standard_normal((1500, 16))
    own = table(spark, "v", x)
    before = shuffled(spark)
    got = {(v.i, v.j) for v in cone_nearest(own, own, F.lit(True), 3, block=20).collect()}
    assert shuffled(spark) - before < 10e6  # a copy for each visit made 54 MB
    assert got == {(i, p) for i, row in enumerate(brute(unit(x), unit(x), np.arange(1500), 3)) for p, _ in row}


def test_languages_share_what_is_shuffled(spark):
    x = np.random.default_rng(1).standard_normal((1200, 16))
    rows = [(f"l{i % 20}", i, v.tolist()) for i, v in enumerate(x)]
    emb = spark.createDataFrame(rows, "lang string, id long, emb array<double>")
    before = shuffled(spark)
    assert r.xsim(emb).agg(F.sum("n")).first()[0] == 1200 * 19
    assert shuffled(spark) - before < 3e6  # a copy for each pair of languages made 8 MB


def test_sql_makes_no_row_for_each_pair(spark):
    """A block of targets is one row to a query, and its best are all that leaves it; queries are dealt over all tasks."""
    own = table(spark, "v", np.random.default_rng(1).standard_normal((40, 4)))
    found = r.sql_nearest(own, own, F.lit(True), 1, block=16)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "array_min" in plan and "RepartitionByExpression" in plan
    assert {(v.i, v.j) for v in found.collect()} == {(i, i) for i in range(40)}
