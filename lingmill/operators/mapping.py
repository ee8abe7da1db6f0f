"""Batched maps: any function over Arrow batches, models over a text column, and a shuffle through a buffer."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..session import ship_package

#: What a task adds to a row: fixed names.
TASKS = {
    "embed": "embeddings array<float>",
    "classification": "predicted_label string, confidence_score double",
    "sentiment": "predicted_label string, confidence_score double",
    "generation": "generated_text string",
}


class TextModel(Protocol):
    def run(self, texts: Sequence[str]) -> list[tuple]:
        """For each text, the values of the task's columns."""


@lru_cache(maxsize=4)
def made_once(make: bytes) -> object:
    """What a pickled function makes, once a worker process. Tasks unpickle functions anew, but their bytes stay equal."""
    return pickle.loads(make)()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows, so that what a task makes of one at a time is small whatever Spark sends; no bytes are copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str, *, remove: Sequence[str] = (), rows: int = 1000) -> DataFrame:
    """f over at most `rows` rows of df at a time, without the columns to remove; it returns batches of schema."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, rows):
            yield f(piece)

    return df.drop(*remove).mapInArrow(run, schema)


def map_model(df: DataFrame, task: str, make: Callable[[], TextModel], text: str = "text", *, rows: int = 32) -> DataFrame:
    """df with a task's columns, by a model that each worker process makes once. A null text is an empty one."""
    if task not in TASKS:
        raise ValueError(f"no such task: {task}; known: {', '.join(TASKS)}")
    added = _parse_datatype_string(TASKS[task])
    clash = {f.name for f in added} & set(df.columns)
    if clash:
        raise ValueError(f"columns are there already: {', '.join(sorted(clash))}")
    schema = StructType([*df.schema.fields, *[StructField(f.name, f.dataType) for f in added]])
    kinds, pickled = to_arrow_schema(schema), cloudpickle.dumps(make)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = made_once(pickled).run([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])
        new = [pa.array([r[k] for r in found], kinds.field(field.name).type) for k, field in enumerate(added)]
        return pa.RecordBatch.from_arrays([*[c.cast(k.type) for c, k in zip(batch.columns, kinds)], *new], names=kinds.names)

    return map_batches(df, f, schema, rows=rows)


def buffer_shuffled(df: DataFrame, buffer: int, seed: int = 42) -> DataFrame:
    """Each task's rows through a buffer: a row takes a random one's place, which goes out; at the end the buffer
    goes out in random order. A task holds `buffer` rows, a batch and what a piece of it pushes out. Works on streams too, a micro-batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held: pa.Table | None = None
        for batch in pieces(batches):
            rows = pa.Table.from_batches([batch])
            first = held.num_rows if held else 0
            rows = pa.concat_tables([held, rows]) if held else rows
            slots, out = list(range(min(rows.num_rows, buffer))), []
            start = max(first, len(slots))
            for row, k in zip(range(start, rows.num_rows), draw.integers(0, buffer, rows.num_rows - start).tolist()):
                out.append(slots[k])
                slots[k] = row
            if out:
                yield from rows.take(pa.array(out)).combine_chunks().to_batches()
            held = rows.take(pa.array(slots, pa.int64())).combine_chunks()
        if held and held.num_rows:
            yield from held.take(pa.array(draw.permutation(held.num_rows))).combine_chunks().to_batches()

    return df.mapInArrow(run, df.schema)
