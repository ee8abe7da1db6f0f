"""The audit of op9_graph_dedup beside a large group."""

import numpy as np

from lingmill.llm.graph_dedup import near_vectors, unit

SCHEMA = "vec_id long, embedding array<double>"


def pairs_beside_a_group(n=1800, dim=64, cosine=0.952, seed=0):
    """A third in one tight group, the rest pairs just within range."""
    r = np.random.default_rng(seed)
    hot = unit(r.standard_normal(dim) + 0.01 * r.standard_normal((n // 3, dim)))
    a = unit(r.standard_normal((n // 3, dim)))
    side = r.standard_normal(a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    return np.concatenate([hot, a, cosine * a + np.sqrt(1 - cosine**2) * side])


def linked(spark, x, **options):
    out = {r.vec_id: r for r in near_vectors(spark.createDataFrame(list(enumerate(x.tolist())), SCHEMA), **options).collect()}
    return np.array([out[i].n_links for i in range(len(x))]), np.array([out[i].component_id for i in range(len(x))])


def test_pairs_are_not_drowned_by_a_group(spark):
    x = pairs_beside_a_group()
    k = len(x) // 3
    links, component = linked(spark, x, shard=20, sample_rows=200)
    assert (links[:k] == k - 1).mean() >= 0.98
    assert links[k:].mean() >= 0.98 and (component[k : 2 * k] == component[2 * k :]).mean() >= 0.98


def test_exact_when_no_attempt_reaches_the_recall(spark):
    x = pairs_beside_a_group(600)
    links, component = linked(spark, x, shard=10, block=128, overlap=1, attempts=1, least_recall=1.0)
    g = unit(x) @ unit(x).T >= 0.95
    assert (links == g.sum(1) - 1).all() and (component[200:400] == component[400:]).all()


def test_rare_pairs_count_from_both_ends(spark):
    """Pairs at 0.951 to 0.96 among many single vectors: found, counted alike from both ends, and the recall is returned."""
    r = np.random.default_rng(4)
    n, pairs = 2500, 100
    x = unit(r.standard_normal((n, 64)))
    side = r.standard_normal((pairs, 64))
    side = unit(side - (side * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    c = r.uniform(0.951, 0.96, (pairs, 1))
    x[pairs : 2 * pairs] = c * x[:pairs] + np.sqrt(1 - c**2) * side
    audits = []
    links, component = linked(spark, x, shard=12, sample_rows=2000, audits=audits)
    assert (links[:pairs] == links[pairs : 2 * pairs]).all() and links[:pairs].mean() >= 0.9 and not links[2 * pairs :].any()
    assert ((component[:pairs] == component[pairs : 2 * pairs]) == (links[:pairs] > 0)).all()
    assert audits and all(0 <= a["recall"] <= 1 for a in audits) and audits[-1]["recall"] >= 0.98
