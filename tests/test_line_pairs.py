"""Line-aligned folders: what is moved to write and read them, and rows that look alike."""

import random

from lingmill.plans.registry import QUERIES
from lingmill.sources import readers


def test_lines_stay_where_they_are_read(spark, tmp_path, capsys):
    """Before, lines were dealt by their split to be joined with its count: one task a split, and every text moved."""
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = readers.lines(spark, str(tmp_path / "a.txt"))
        df.explain()
        plan = capsys.readouterr().out
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert [(r.line, r.value) for r in df.orderBy("line").collect()] == [(0, "one"), (1, "two")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def pairs_of(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{path}/documents.parquet")
    return [(r.line, r.source_text, r.target_text) for r in QUERIES["line_pair_files"](spark, str(path)).orderBy("line").collect()]


def test_rows_that_look_alike(spark, tmp_path):
    rows = [(3, "s", "en", "c"), (1, "s", "en", "a\nA"), (1, "s", "en", "a\nA"), (1, "s", "fr", "x"), (2, "s", "fr", "x"), (None, "t", "en", "n"), (None, "t", "fr", "m"), (4, "u", "en", "alone"), (5, None, "en", "p"), (6, None, "fr", "q")]
    assert pairs_of(spark, tmp_path / "a", rows) == [(0, "n", "m"), (1, "a A", "x"), (2, "a A", "x")]


def test_texts_are_moved_only_to_be_sorted_and_zipped(spark, tmp_path):
    """Before, each text also went to the numbering of its language and to the join of pairs."""
    r = random.Random(4)
    rows = [(i, "s", "en" if i % 2 else "fr", r.randbytes(10_000).hex()) for i in range(400)]
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: store.executorList(False).apply(0).totalShuffleWrite()
    before, start = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), written()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert len(pairs_of(spark, tmp_path / "b", rows)) == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = (written() - start) / sum(len(r[3]) for r in rows)
    assert 0 < moved < 4


def test_no_pairs(spark, tmp_path):
    assert pairs_of(spark, tmp_path / "c", [(1, "s", "en", "a")]) == []
