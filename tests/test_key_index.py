import random

import pytest
from pyspark.sql import functions as F

from lingmill.operators.curate import dedup
from lingmill.operators.key_index import KeyIndex, dedup_batch, digest

SCHEMA = "id long, source_text string, target_text string, source_nllb_code string, target_nllb_code string"


def bitext(n=900, seed=1):
    r = random.Random(seed)
    say = lambda: r.choice([None, "", "  ", f"Text {r.randrange(90)}!", f"text{r.randrange(90)}", f"été {'x' * r.randrange(60)}"])
    hot = lambda: "one line that a third of all rows share"
    return [(i, (hot if r.random() < 0.33 else say)(), say(), r.choice(["eng_Latn", "fra_Latn"]), r.choice(["deu_Latn", None])) for i in range(n)]


@pytest.mark.parametrize("direction", ["source", "target", "both"])
def test_increments_equal_one_run(spark, tmp_path, direction):
    rows = bitext()
    want = sorted(map(str, dedup(spark.createDataFrame(rows, SCHEMA), direction).collect()))
    got = []
    for k, (low, high) in enumerate(((0, 300), (300, 301), (301, 301), (301, 900))):
        got += dedup_batch(spark.createDataFrame(rows[low:high], SCHEMA), f"{tmp_path}/index", f"b{k}", direction, buckets=8).collect()
    assert sorted(map(str, got)) == want


def test_a_batch_runs_again_and_compaction_changes_nothing(spark, tmp_path):
    rows = [spark.createDataFrame(bitext(200, s), SCHEMA).withColumn("id", F.col("id") + 1000 * s) for s in (1, 2, 3)]
    run = lambda k, where: sorted(r.id for r in dedup_batch(rows[k], str(where), f"b{k}", buckets=4).collect())
    first, second = run(0, tmp_path / "a"), run(1, tmp_path / "a")
    assert run(1, tmp_path / "a") == second and run(0, tmp_path / "a") == first
    third = run(2, tmp_path / "a")
    for k in (0, 1):
        run(k, tmp_path / "b")
    for side in ("source", "target"):
        index = KeyIndex(spark, f"{tmp_path}/b/{side}", 4)
        index.compact()
        assert [c["names"] for c in index.commits()] == [["b0", "b1"]]
    assert run(2, tmp_path / "b") == third
    with pytest.raises(ValueError, match="compacted"):
        run(0, tmp_path / "b")


def test_what_is_not_committed_does_not_count(spark, tmp_path, monkeypatch):
    index = KeyIndex(spark, str(tmp_path / "i"), 4)
    keys = lambda *v: spark.createDataFrame([(x,) for x in v], "v string").select(digest(F.col("v")).alias("digest"))
    index.add(keys("a", "b"), "one")

    class Broken(KeyIndex):
        def _files(self):
            raise OSError("lost before the commit")

    broken = Broken(spark, str(tmp_path / "i"), 4)
    monkeypatch.setattr(Broken, "commits", lambda self: index.commits())
    with pytest.raises(OSError):
        broken.add(keys("c"), "two")
    assert index.seen(keys("a", "c"), "three").count() == 1
    index.add(keys("c", "d"), "two")
    assert index.seen(keys("a", "c", "e"), "three").count() == 2 and index.seen(keys("a", "c"), "two").count() == 1


def test_few_buckets_are_read(spark, tmp_path):
    """A batch's lookup reads the buckets that its keys may be in, and of a batch of new keys hardly any."""
    index = KeyIndex(spark, str(tmp_path / "i"), 32)
    keys = lambda low, high: spark.range(low, high).select(digest(F.col("id").cast("string")).alias("digest"))
    index.add(keys(0, 20_000), "one")
    every = index.held(list(range(32)), "two").inputFiles()
    may = index.may_hold(keys(0, 3), "two")
    buckets = [r.bucket for r in may.select("bucket").distinct().collect()]
    read = index.held(buckets, "two")
    files = {r.f for r in read.select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    assert len(every) >= 32 and 1 <= len(buckets) <= 3 and 1 <= len(files) <= 3
    assert index.seen(keys(0, 3), "two").count() == 3
    assert index.may_hold(keys(50_000, 51_000), "two").count() < 40  # about one in a hundred
    assert index.seen(keys(19_990, 20_010), "two").count() == 10


def test_digests_tell_nulls_and_joins_apart(spark):
    rows = [("a", "b"), ("ab", ""), (None, "b"), ("null", "b"), ("a", None), ("", None), (None, None), ("", "")]
    assert spark.createDataFrame(rows, "x string, y string").select(digest(F.col("x"), F.col("y")).alias("d")).distinct().count() == len(rows)
