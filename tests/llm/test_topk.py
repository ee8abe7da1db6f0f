import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from lingmill.llm.topk import LEAST, MOST, class_search, products, top_products, topk_query

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("score", StringType())])


def whole(x):
    f = np.floor(1024 * np.float64(x))
    return MOST if f >= 2.0**63 else LEAST if f <= -(2.0**63) else int(f)


def brute(rows, k=10):
    """Whole numbers of any size, every query against every other id."""
    by = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = [whole(x) for x in v]
        by[i] = min(by[i], v) if i in by else v
    out = []
    for q, a in by.items():
        if q % 100:
            continue
        scored = sorted((-max(LEAST, min(MOST, sum(x * y for x, y in zip(a, b)))), i) for i, b in by.items() if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)


def test_products_of_any_size():
    for high in (1 << 10, 1 << 28, 1 << 40, (1 << 63) - 1):
        r = random.Random(high)
        a, b = ([[r.randint(-high, high) for _ in range(5)] for _ in range(n)] for n in (3, 4))
        assert products(np.array(a), np.array(b)).astype(object).tolist() == [[sum(x * y for x, y in zip(v, w)) for w in b] for v in a]


def test_equals_brute_force(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((8, 12))
    rows = [(i, (centres[i % 8] + 0.3 * r.standard_normal(12)).tolist()) for i in range(900)]
    rows += [(1000 + i, [0.25] * 12) for i in range(450)]  # a third are copies, queries among them
    rows += [(2000 + i, (5 * centres[i % 8]).round(1).tolist()) for i in range(40)]  # ties
    got = topk_query(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -2.5]), (100, [1.0]), (200, []), (300, None), (400, [nan, 1.0]), (500, [None, 1.0]), (None, [1.0, 1.0]), (600, [inf, 0.0]), (7, [0.0, 0.0]), (8, [-0.0001, 3.0]), (8, [-0.0001, 3.0]), (9, [1.0, 2.0]), (9, [0.5, 2.0]), (700, [1e300, -1e300]), (10, [1e17, 1e-300]), (11, [-3e15, 2e15])]
    assert sorted(map(tuple, topk_query(table(spark, rows)).collect())) == brute(rows)
    assert topk_query(table(spark, [])).count() == 0
    assert topk_query(table(spark, [(100, [1.0])])).count() == 0


def test_cutoff_rules_out_most(spark):
    """Blocks and parts of any number give the same rows; nodes collect a small share of all pairs."""
    from lingmill.llm import topk

    r = np.random.default_rng(4)
    rows = [(i, r.standard_normal(16).tolist()) for i in range(3000)]
    df, asks = table(spark, rows), F.pmod("vec_id", F.lit(100)) == 0
    want = brute(rows)
    for sizes in ({"parts": 1}, {"parts": 3, "block": 400, "query_block": 7}, {"parts": 16, "block": 1000}):
        assert sorted(map(tuple, top_products(df, asks, **sizes).collect())) == want
    held = topk._collect
    seen = spark.sparkContext.accumulator(0)

    def counted(batches, **kw):
        for b in held(batches, **kw):
            seen.add(b.num_rows)
            yield b

    topk._collect = counted
    try:
        classes = df.select(F.col("vec_id").alias("id"), topk.scaled(F.col("embedding")).alias("vector"))
        class_search(classes, classes.filter("id % 100 = 0"), k=11, width=16, block=200).count()
    finally:
        topk._collect = held
    assert 30 * 11 <= seen.value < 0.2 * 30 * 3000
