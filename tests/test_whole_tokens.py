"""Token queries on every word of a text."""

import math

from lingmill.operators import noise
from lingmill.plans import fixtures as fx
from lingmill.plans.registry import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_noise_reaches_every_word(spark):
    words = {r.doc_id: len(r.text.split(" ")) for r in fx.load(spark, SF, "documents").select("doc_id", "text").collect()}
    assert max(words.values()) > 400
    out = QUERIES["noise_compose"](spark, SF).collect()
    assert len(out) == len(words)
    for r in out:
        n, masked, noised = words[r.id], r.masked.split(","), r.noised.split(",")
        assert len(masked) == n and masked.count("3") == (math.ceil(0.3 * (n - 2)) if n > 2 else 0)
        assert len(noised) == (n + math.ceil(0.1 * n) if n > 2 else n)


def test_masks_by_rank_of_long_rows(spark):
    df = spark.createDataFrame([(k, list(range(10, 10 + n))) for k, n in enumerate((0, 1, 2, 3, 50, 20_000))], "id long, ids array<int>")
    for share in (0.0, 0.3, 1.0):
        rows = df.select("id", "ids", noise.masked_by_rank(F.col("ids"), F.col("id"), share, 3).alias("x")).collect()
        for r in rows:
            body = max(0, len(r.ids) - 2)
            assert len(r.x) == len(r.ids) and r.x[:1] == r.ids[:1] and r.x[-1:] == r.ids[-1:]
            assert sum(a != b for a, b in zip(r.x, r.ids)) == sum(a == 3 for a in r.x) == math.ceil(share * body)
