"""A stream shuffled through state, over a restart."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingmill.streaming.shuffle import PROVIDER, shuffled_stream, through

CONF = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(CONF)
    spark.conf.set(CONF, PROVIDER)
    yield
    spark.conf.set(CONF, before)


def test_rows_mix_over_micro_batches_and_a_restart(spark, tmp_path, rocks):
    source, got = tmp_path / "in", []
    schema = "id long, t string, v array<double>, file int, last boolean"

    def put(n, rows):
        df = spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([(None, None, None, None, True)], schema)
        df.coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        out = shuffled_stream(stream, 120, slots=4, drain=F.col("last"))
        sink = lambda df, batch: got.extend((batch, r.id, r.t, tuple(r.v), r.file) for r in df.collect())
        q = out.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").start()
        q.awaitTermination(240)
        assert not q.isActive and q.exception() is None

    rows = lambda n: [(i, f"é{i}", [i / 2, None], n, False) for i in range(300 * n, 300 * n + 300)]
    for n in range(2):
        put(n, rows(n))
    run()
    first = len(got)
    assert first == 600 - 120  # four full buffers stay
    put(2, rows(2))
    run()  # a new query from the checkpoint
    put(3, [])
    run()
    assert Counter(x[1] for x in got) == Counter(range(900)) and all(t == f"é{i}" and v[0] == i / 2 for _, i, t, v, _ in got)
    by_batch = {}
    for batch, _, _, _, file in got:
        by_batch.setdefault(batch, set()).add(file)
    assert any(len(files) > 1 for files in by_batch.values())
    assert any(file < 2 for _, _, _, _, file in got[first:])  # rows from before the restart
    order = [x[1] for x in got]
    assert order != sorted(order)


def test_a_buffer_keeps_and_gives_each_row_once():
    held, seen, out = [], 0, []
    for n in (0, 3, 50, 1, 200):
        rows = held + list(range(seen, seen + n))
        gone, stay = through(len(held), n, 20, np.random.default_rng([1, seen]))
        out += [rows[i] for i in gone]
        held, seen = [rows[i] for i in stay], seen + n
        assert len(held) == min(20, seen)
    assert sorted(out + held) == list(range(254))
