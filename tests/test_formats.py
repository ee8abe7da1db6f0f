"""Arrow folders, row groups, malformed rows, model maps, buffer shuffles, subword BLEU, schedules by group."""

import gzip
import math
import os
import uuid
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lingmill.functions import sequences
from lingmill.operators import batching, mapping, metrics, sinks
from lingmill.sources import readers


def test_arrow_round_trip(spark, tmp_path):
    df = spark.range(1000).select("id", F.concat(F.lit("é"), F.col("id")).alias("t"), F.array("id", F.lit(None)).alias("a")).repartition(3)
    sinks.write_as(df, str(tmp_path / "x"), "arrow")
    sinks.write_as(df, str(tmp_path / "x"), "arrow")
    assert len(list((tmp_path / "x").glob("*.arrow"))) == 3 and not list((tmp_path / "x").glob("_part*"))
    back = readers.arrow(spark, str(tmp_path / "x"))
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())
    with pa.ipc.new_stream(str(tmp_path / "s.arrow"), pa.schema([("k", pa.int32())])) as w:
        w.write_batch(pa.RecordBatch.from_pydict({"k": pa.array([1, None], pa.int32())}))
    assert [r.k for r in readers.by_extension(spark, str(tmp_path / "s.arrow")).collect()] == [1, None]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        readers.arrow(spark, str(tmp_path / "none"))


def test_row_groups(spark, tmp_path):
    sinks.write_shards(spark.range(0, 2500, 1, 1), str(tmp_path / "p"), group_rows=1000)
    found = pq.ParquetFile(next((tmp_path / "p").glob("*.parquet"))).metadata
    assert [found.row_group(i).num_rows for i in range(found.num_row_groups)] == [1000, 1000, 500]


def test_malformed_rows_are_reported(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b,c\n1,"x, y",z\n1,2\n\n1,2,3,4\n4,,6\n')
    rows, bad = readers.multilingual_csv(spark, str(tmp_path / "m.csv"), ["a", "b", "c"])
    assert [tuple(r) for r in rows.collect()] == [("1", "x, y", "z"), ("4", None, "6")]
    assert [r.line for r in bad.collect()] == ["1,2", "1,2,3,4"]


def test_gzip_member(spark, tmp_path):
    (tmp_path / "t.txt.gz").write_bytes(gzip.compress("un\ndeux\n".encode()))
    assert [(r.name, r.value) for r in readers.members(spark, str(tmp_path / "t.txt.gz")).collect()] == [("t.txt", "un"), ("t.txt", "deux")]


def test_model_map(spark):
    class Lengths:
        def run(self, texts):
            return [("long" if len(t) > 2 else "short", len(t) / 10) for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id int, text string")
    out = {r.id: (r.predicted_label, r.confidence_score) for r in mapping.map_model(df, "sentiment", Lengths, rows=2).collect()}
    assert out == {1: ("long", 0.3), 2: ("short", 0.0), 3: ("short", 0.0)}
    with pytest.raises(ValueError):
        mapping.map_model(df, "translate", Lengths)
    with pytest.raises(ValueError):
        mapping.map_model(df.withColumn("generated_text", F.lit("")), "generation", Lengths)


def test_models_are_made_once_a_worker(spark, tmp_path):
    """A closure too, though every task unpickles it anew."""
    folder = str(tmp_path)

    class Plain:
        def run(self, texts):
            return [("x", 0.5) for _ in texts]

    def make():
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return Plain()

    df = spark.range(0, 400, 1, 16).withColumn("text", F.lit("t"))
    assert mapping.map_model(df, "sentiment", make, rows=5).filter("confidence_score = 0.5").count() == 400
    per = Counter(name.split("-")[0] for name in os.listdir(folder))
    assert per and set(per.values()) == {1}


def test_buffer_shuffle(spark):
    df = spark.range(0, 5000, 1, 2).withColumn("t", F.col("id").cast("string"))
    out = [r.id for r in mapping.buffer_shuffled(df, 100).collect()]
    assert Counter(out) == Counter(range(5000)) and out != sorted(out)
    assert out == [r.id for r in mapping.buffer_shuffled(df, 100).collect()]
    # a row never comes out before those that a buffer holds have come in
    assert all(x <= at + 100 for at, x in enumerate(out[:2500]))
    assert sorted(r.id for r in mapping.buffer_shuffled(spark.range(7), 100).collect()) == list(range(7))
    assert mapping.buffer_shuffled(spark.range(0), 3).count() == 0


def test_subword_bleu(spark):
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on a mat"), (2, "same words here again", "same words here again"), (2, None, "")], "g int, preds string, labels string")
    out = {r.g: r.bleu for r in metrics.corpus_bleu(df, ["g"], tokenize=metrics.subwords(path)).collect()}
    assert 0 < out[1] < 100 and out[2] == 100.0


def test_grouped_schedules(spark):
    rows = {(r.name, r.step): r.factor for r in metrics.grouped_schedules(spark, 100, warmup=40).collect()}
    assert len(rows) == 300 and rows["shared", 0] == 0.001 and rows["shared", 40] == 1.0 == rows["other", 40]
    assert all(abs(rows["specific", t] - 1 / math.sqrt((t + 20) / 20)) < 1e-8 for t in (0, 7, 99))


def test_first_token_and_evaluation_rows(spark):
    df = spark.createDataFrame([(1, [5, 9], [6], False), (2, [7], [], True), (3, [], [1], True)], "id int, source_ids array<int>, target_ids array<int>, eval boolean")
    codes = df.select("id", sequences.code_of_first(F.col("source_ids"), {5: "eng_Latn", 6: "fra_Latn"}).alias("c"))
    assert {r.id: r.c for r in codes.collect()} == {1: "eng_Latn", 2: None, 3: None}
    out = batching.expand_pairs(df, F.lit(True), whole=F.col("eval")).collect()
    assert sorted((r.id, r.side, r.input_ids, r.labels, r.mse) for r in out if r.id > 1) == [(2, 0, [7], [], None), (3, 0, [], [1], None)] and sum(r.id == 1 for r in out) == 2


def test_lines_are_numbered_over_splits(spark, tmp_path):
    want = []
    for name, n in (("b.txt", 3000), ("a.txt", 0), ("c.txt", 1700)):
        own = [f"{name} {i} " + "x" * (i % 37) for i in range(n)]
        (tmp_path / name).write_bytes("".join(x + ("\r\n" if i % 2 else "\n") for i, x in enumerate(own)).encode())
        want += own
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        df = readers.lines(spark, *[str(tmp_path / x) for x in ("b.txt", "a.txt", "c.txt")])
        rows = sorted(df.collect(), key=lambda r: r.line)
        assert [(r.line, r.value) for r in rows] == list(enumerate(want))
        assert {r.file for r in rows} == {0, 2}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
