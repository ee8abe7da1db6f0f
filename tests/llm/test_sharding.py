import math
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from lingmill.llm.sharding import Tree, assign, place, sharding_query

SCHEMA = "doc_id long, text string, shard string, slot string, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)


def test_law_slots_and_digests(spark):
    rows = [(i, "t" * (i % 50)) for i in range(4000)] + [(7, "again"), (7, "again"), (None, None), (None, "é")]
    out = sharding_query(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=str) == want
    slots = {}
    for r in out:
        assert r.law == "key" and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(slots) == 40 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(60 < len(s) < 145 for s in slots.values())
    assert len({r.shard for r in out if r.doc_id == 7}) == 1


def placed(spark, n, *trees):
    df = spark.range(n).withColumn("k", F.col("id").cast("string"))
    for i, tree in enumerate(trees):
        df = place(df, F.col("k"), tree, f"t{i}")
    return [tuple(r) for r in df.select("id", *[f"t{i}" for i in range(len(trees))]).collect()]


def draw(key, name, weight):
    h = xxhash.xxh64_intdigest(name.encode(), seed=xxhash.xxh64_intdigest(key.encode(), seed=42))
    return -math.log((h % (1 << 52) + 0.5) / (1 << 52)) / weight


def descend(key, weights, per_rack, per_region):
    """A plain descent: the least draw of the regions, of the racks below it, of the shards below that."""
    shards = list(range(len(weights)))
    racks = [shards[i : i + per_rack] for i in range(0, len(shards), per_rack)]
    regions = [list(range(i, min(i + per_region, len(racks)))) for i in range(0, len(racks), per_region)]
    total = lambda ss: sum(weights[s] for s in ss)
    least = lambda nodes: min((draw(key, name, w), at) for name, w, at in nodes if w > 0)[1]
    r = least([(f"region-{r}", total([s for k in ks for s in racks[k]]), r) for r, ks in enumerate(regions)]) if sum(total([s for k in ks for s in racks[k]]) > 0 for ks in regions) > 1 else next(r for r, ks in enumerate(regions) if any(weights[s] for k in ks for s in racks[k]))
    inner = [(f"rack-{r}-{i}", total(racks[k]), k) for i, k in enumerate(regions[r])]
    k = least(inner)
    return least([(f"shard-{s}", weights[s], s) for s in racks[k]])


@pytest.mark.parametrize("per_rack, per_region", [(5, 4), (3, 2), (41, 1), (1, 7)])
def test_equals_a_plain_descent(spark, per_rack, per_region):
    weights = [1.0 + i % 3 for i in range(40)] + [0.0]
    for i, shard in placed(spark, 1500, Tree.of(weights, per_rack, per_region)):
        assert shard == descend(str(i), weights, per_rack, per_region)


def test_levels_change_placements(spark):
    rows = placed(spark, 2000, Tree.even(40), Tree.even(40, per_rack=2), Tree.even(40, per_region=2))
    assert any(a != b for _, a, b, _ in rows) and any(a != c for _, a, _, c in rows)


def test_movement_stays_in_changed_subtrees(spark):
    weights = [1.0] * 24
    heavier = [*weights[:7], 4.0, *weights[8:]]
    rows = placed(spark, 20000, Tree.of(weights, 4, 3), Tree.of(heavier, 4, 3))
    moved = [(a, b) for _, a, b in rows if a != b]
    # shard 7 stands in rack 1 of region 0, of shards 4 to 7; region 0 has shards 0 to 11
    for a, b in moved:
        if a // 12 != b // 12:
            assert b // 12 == 0
        elif a // 4 != b // 4:
            assert b // 4 == 1
        else:
            assert b == 7
    share = Counter(b for _, _, b in rows)
    assert abs(share[7] / 20000 - 4 / 27) < 0.02 and all(abs(share[s] / 20000 - 1 / 27) < 0.01 for s in range(24) if s != 7)


def test_any_growth_moves_into_the_new_shard_only(spark):
    for n in (1, 4, 19, 40, 41):
        tree = Tree.even(n)
        for _, a, b, c in placed(spark, 3000, tree, tree.plus(), tree.plus().plus(2.0)):
            assert b in (a, n) and c in (b, n + 1)


def test_trees_need_weight():
    with pytest.raises(ValueError):
        Tree.of([0.0])
    with pytest.raises(ValueError):
        Tree.of([1.0, -1.0])


def test_very_long_and_repeated_rows(spark):
    rows = [(None, "x" * 2_000_000)] * 3 + [(None, str(i)) for i in range(500)] + [(1, "same")] * 200
    out = sharding_query(frame(spark, rows)).collect()
    assert sorted(r.size for r in out)[-1] == 2_000_016 and len({r.shard for r in out if r.doc_id is None}) == 1
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_empty_table(spark):
    assert assign(frame(spark, []), Tree.even(3)).count() == 0


def test_plans_do_not_grow_with_the_tree(spark):
    """Nodes are data: the generated code of a tree of 1,000 shards is as long as that of 40."""

    def plan(shards):
        tree = Tree.even(shards)
        df = place(spark.range(5).withColumn("k", F.col("id").cast("string")), F.col("k"), tree, "s")
        assert df.select("s").distinct().count()
        return spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(df._jdf.queryExecution().executedPlan())

    small, large = plan(40), plan(1000)
    assert len(large) < 2 * len(small) < 200_000
