import pyarrow as pa
import pytest

from lingmill.operators import lid_model
from lingmill.operators.mapping import buffer_shuffled, pieces


def test_pieces_hold_every_row_once():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 3, 10)]
    got = list(pieces(iter(batches), 4))
    assert [p.num_rows for p in got] == [3, 4, 4, 2]
    assert [v for p in got for v in p.column(0).to_pylist()] == [*range(3), *range(10)]


@pytest.fixture
def large_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    yield
    spark.conf.set(key, before)


def test_a_buffer_takes_a_large_batch_in_pieces(spark, large_batches):
    df = spark.range(4000).repartition(1).selectExpr("id", "repeat('x', 10) AS text")
    assert sorted(r.id for r in buffer_shuffled(df, 100).select("id").collect()) == list(range(4000))


def test_scores_are_made_a_piece_at_a_time():
    """A task's batch of 4,000 rows goes out in pieces, with what one piece had."""
    class Held:
        value = lid_model.NgramModel((), lid_model.np.zeros((0, 1 << lid_model.BITS)))

    batch = pa.RecordBatch.from_pydict({"text": ["a b"] * 4000})
    out = list(lid_model._score(iter([batch]), model=Held, columns=("text",)))
    assert len(out) > 1 and max(b.num_rows for b in out) <= 500
    assert sum(b.num_rows for b in out) == 4000
