"""Shuffle of a stream through buffers that are state: rows of different micro-batches mix, and a restart goes on where it was.

Rows are dealt to slots by a hash. A slot's state is a buffer; a row that comes to a full one takes the place of a random row of it, which
goes out. The draws follow from the seed, the slot and the number of rows it has seen, so a micro-batch that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..session import ship_package

#: Columns that are added to a stream's own.
DRAIN, SLOT = "lingmill_drain", "lingmill_slot"
#: State stores of transformWithState.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def through(held: int, new: int, cap: int, draw: np.random.Generator) -> tuple[list[int], list[int]]:
    """Which of held + new rows, numbered as they came, go out and which stay in a buffer of cap."""
    stay, out = list(range(min(held + new, cap))), []
    first = max(held, len(stay))
    for row, k in zip(range(first, held + new), draw.integers(0, cap, max(0, held + new - first)).tolist()):
        out.append(stay[k])
        stay[k] = row
    return out, stay


class Buffer(StatefulProcessor):
    """A slot's buffer as one Arrow table, and how many rows it has seen."""

    def __init__(self, schema: StructType, cap: int, seed: int):
        self.schema, self.cap, self.seed = schema, cap, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("buffer", "rows binary, seen long")

    def _frame(self, table: pa.Table) -> pd.DataFrame:
        return table.to_pandas()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kinds = to_arrow_schema(self.schema)
        table, seen = kinds.empty_table(), 0
        if self.state.exists():
            raw, seen = self.state.get()
            table = pa.ipc.open_stream(pa.py_buffer(bytes(raw))).read_all()
        drained = False
        for pdf in rows:
            pdf.columns = [*kinds.names, DRAIN, SLOT]  # names that start with an underscore don't reach here
            drain = pdf[DRAIN].to_numpy(dtype=bool)
            drained |= bool(drain.any())
            new = pa.Table.from_pandas(pdf.loc[~drain, list(kinds.names)], schema=kinds, preserve_index=False)
            draw = np.random.default_rng([self.seed, int(key[0]), seen])
            out, stay = through(table.num_rows, new.num_rows, self.cap, draw)
            seen += new.num_rows
            both = pa.concat_tables([table, new])
            table = both.take(pa.array(stay, pa.int64()))
            if out:
                yield self._frame(both.take(pa.array(out, pa.int64())))
        if drained and table.num_rows:
            draw = np.random.default_rng([self.seed, int(key[0]), seen, 1])
            yield self._frame(table.take(pa.array(draw.permutation(table.num_rows))))
            table = kinds.empty_table()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kinds) as w:
            w.write_table(table.combine_chunks())
        self.state.update((sink.getvalue().to_pybytes(), seen))

    def close(self) -> None:
        pass


def shuffled_stream(stream: DataFrame, buffer: int, *, slots: int = 16, seed: int = 42, drain: Column | None = None) -> DataFrame:
    """The stream's rows in another order, each once; about `buffer` rows are held at any time, over `slots` states.

    A row for which drain holds is no data: it makes every slot give out what it holds, at the end of the stream for instance. A task
    holds one slot's buffer and a batch of its rows. Equal rows meet in one slot. The session's state store must be RocksDB's (PROVIDER).
    """
    ship_package(stream.sparkSession)
    schema = stream.schema
    ends = F.coalesce(drain, F.lit(False)) if drain is not None else F.lit(False)
    every = F.sequence(F.lit(0), F.lit(slots - 1))
    own = F.array(F.pmod(F.xxhash64(*stream.columns, F.lit(seed)), F.lit(slots)).cast("int"))
    dealt = stream.withColumn(DRAIN, ends).withColumn(SLOT, F.explode(F.when(F.col(DRAIN), every).otherwise(own)))
    processor = Buffer(schema, max(1, buffer // slots), seed)
    return dealt.groupBy(SLOT).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")
