import math

import numpy as np

from lingmill.llm.ann import KdTree, ann_query, chi_square_cdf, chi_square_point, nearest
from lingmill.llm.graph_dedup import build, near_vectors, search, unit
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", 1) for i, v in rows], SCHEMA)


def vectors(n=900, dim=16, seed=0):
    """Random vectors, groups of near copies of many sizes, exact copies and scaled ones."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    for start, size, noise in ((0, 120, 0.05), (200, 60, 0.1), (300, 30, 0.18), (400, 10, 0.02)):
        x[start : start + size] = x[start] + noise * r.standard_normal((size, dim))
    x[500:540] = x[500]
    x[540] = 3 * x[500]
    return x.astype(np.float32)


BAD = [(10_000, None), (10_100, [0.0] * 16), (10_200, [float("nan")] + [1.0] * 15), (10_300, [float("inf")] + [1.0] * 15), (10_400, [None] + [1.0] * 15), (None, [1.0] * 16)]


def test_chi_square():
    assert abs(chi_square_cdf(chi_square_point(0.9, 10), 10) - 0.9) < 1e-9
    assert abs(chi_square_point(0.95, 1) - 3.8414588) < 1e-5 and abs(chi_square_point(0.5, 2) - 2 * math.log(2)) < 1e-9


def test_kd_tree_gives_leaves_by_distance():
    x = np.random.default_rng(1).standard_normal((500, 4))
    tree, q = KdTree(x, leaf=16), np.zeros(4)
    gaps, seen = [], []
    for gap, members in tree.leaves(q):
        gaps.append(gap)
        seen += members.tolist()
        assert ((x[members] ** 2).sum(1) >= gap - 1e-12).all()
    assert gaps == sorted(gaps) and sorted(seen) == list(range(500))


def test_nearest_against_brute_force(spark):
    x = vectors()
    rows = [*enumerate(x.tolist()), *BAD]
    out = ann_query(frame(spark, rows)).collect()
    wide = x.astype(np.float64)
    hits = total = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert all(abs(r.score - d[r.vec_id]) < 1e-12 for r in got)
        assert [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        hits, total = hits + len(set(want) & {r.vec_id for r in got}), total + 10
    assert hits >= 0.9 * total and {r.query_id for r in out} == set(range(0, 900, 100))


def test_blocks_give_the_same_rows(spark):
    df = frame(spark, list(enumerate(vectors()[:300].tolist())))
    one = nearest(df, F.col("vec_id") % 10 == 0, confidence=0.999999)
    many = nearest(df, F.col("vec_id") % 10 == 0, confidence=0.999999, block=40, query_block=7)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_few_candidates_and_empty_tables(spark):
    out = ann_query(frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])])).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert ann_query(frame(spark, [])).count() == 0 and ann_query(frame(spark, BAD)).count() == 0
    assert near_vectors(frame(spark, [])).count() == 0


def exact(x):
    u = unit(x.astype(np.float64))
    g = u @ u.T >= 0.95
    np.fill_diagonal(g, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], root[g[i]].min(initial=root[i])) for i in range(len(x))])
        if (new == root).all():
            return g, root
        root = new


def test_graph_dedup_against_brute_force(spark):
    x = vectors()
    g, root = exact(x)
    for options in ({}, {"shard": 150, "block": 64}):
        out = {r.vec_id: r for r in near_vectors(frame(spark, [*enumerate(x.tolist()), *BAD]), **options).collect()}
        assert len(out) == 906
        links = np.array([out[i].n_links for i in range(900)])
        assert (links <= g.sum(1)).all() and links.sum() >= 0.95 * g.sum()
        assert np.mean([out[i].component_id == root[i] for i in range(900)]) >= 0.98
        for i, _ in BAD:
            assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
        assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out.values())


def test_search_finds_what_is_in_range():
    x = unit(np.random.default_rng(3).standard_normal((400, 8)))
    x[:150] = unit(x[0] + 0.1 * np.random.default_rng(4).standard_normal((150, 8)))
    a = build(x, near=32, spread=16, degree=24)
    hits = search(x, np.arange(400), x, a, 7)
    want = x @ x.T >= 0.95
    assert not (hits & ~want).any() and hits.sum() >= 0.97 * want.sum()


def test_repeated_ids_and_other_lengths(spark):
    out = near_vectors(frame(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0])])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
