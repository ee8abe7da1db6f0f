import numpy as np
import pytest
from pyspark.sql import functions as F

from lingmill.operators import retrieval as r
from lingmill.operators.cones import ConeIndex, cone_nearest, cone_search
from lingmill.session import load

SF = "/root/testdata/sf0.01"


def table(spark, lang, x):
    return spark.createDataFrame([(lang, i, v.tolist()) for i, v in enumerate(x)], "lang string, pos long, emb array<double>")


def clustered(seed, n, groups=24, dim=16):
    g = np.random.default_rng(seed)
    centres = np.random.default_rng(0).standard_normal((groups, dim))
    return centres[g.integers(0, groups, n)] + 0.08 * g.standard_normal((n, dim))


def brute(q, t, k):
    u = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    sims = np.round(u(q) @ u(t).T, 9)
    return {(i, int(j)) for i, row in enumerate(sims) for j in np.lexsort((np.arange(len(t)), -row))[:k]}


def test_exact_and_skips_what_the_bound_rules_out(spark):
    x, y = clustered(1, 900), clustered(2, 1200)
    y[100:500] = y[100]  # a third are copies
    y[7] = 0
    x[3] = 0
    q, t = ConeIndex.of(table(spark, "a", x), block=40), ConeIndex.of(table(spark, "b", y), block=40)
    assert q.rows.groupBy("cell", "block").count().agg(F.max("count")).first()[0] <= 100  # hashed blocks are about 40
    found, visited = cone_search(q, t, F.lit(True), 4)
    got = {(r_.i, r_.j) for r_ in found.collect()}
    assert got == brute(x, y, 4)
    possible = q.cones.count() * t.cones.count()
    seen = visited.collect()
    assert len(seen) == len({(v.qc, v.tc) for v in seen}) < 0.5 * possible
    assert max(v.wave for v in seen) >= 1


def test_no_visit_that_the_bound_rules_out(spark):
    """After the last wave, what was not visited can't reach any query's k-th, and a later visit could when it was made."""
    x = clustered(5, 600)
    index = ConeIndex.of(table(spark, "a", x), block=25)
    found, visited = cone_search(index, index, F.lit(True), 3)
    assert {(r_.i, r_.j) for r_ in found.collect()} == brute(x, x, 3)
    cones = {c.cell: (np.array(c.centre), c.width) for c in index.cones.collect()}
    cell = {p.pos: p.cell for p in index.rows.select("pos", "cell").collect()}
    kth = {}
    for f in found.filter("rank = 3").collect():
        kth[cell[f.i]] = min(kth.get(cell[f.i], 2), f.sim)
    went = {(v.qc, v.tc): v.wave for v in visited.collect()}
    for a, (ca, wa) in cones.items():
        for b, (cb, wb) in cones.items():
            bound = np.cos(max(0, np.arccos(np.clip(ca @ cb, -1, 1)) - wa - wb))
            assert (a, b) in went or bound < kth[a]


def test_same_as_the_grid(spark):
    emb = load(spark, SF, "embeddings").select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("lang"), F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))
    small = lambda q, t, pair, k: cone_nearest(q, t, pair, k, block=10)
    for margin in ("absolute", "ratio"):
        want, got = (sorted(map(tuple, r.xsim(emb, margin=margin, search=s).collect())) for s in (r.nearest, small))
        assert want == got


def test_edges(spark):
    empty = table(spark, "a", np.zeros((0, 3)))
    one = table(spark, "b", np.ones((1, 3)))
    assert cone_nearest(empty, one, F.lit(True), 2).count() == 0
    assert [(x.i, x.j) for x in cone_nearest(one, one, F.lit(True), 2).collect()] == [(0, 0)]
    few = cone_nearest(table(spark, "a", clustered(1, 30)), table(spark, "b", clustered(2, 3)), F.lit(True), 5, block=4)
    assert few.count() == 90


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_takes_cones_for_large_languages(spark, k):
    x, y = clustered(1, 300), clustered(2, 400)
    q, t = table(spark, "a", x), table(spark, "b", y)
    got = r.nearest(q, t, F.lit(True), k, block=50)
    assert {(v.i, v.j) for v in got.collect()} == brute(x, y, k)
