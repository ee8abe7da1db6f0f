"""Running sums within groups of any size, without one task for a group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, ship_package


def _sum(batches: Iterator[pa.RecordBatch], *, key: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds running sums of rows that are sorted by key."""
    last, carried = None, {}
    for batch in batches:
        k = batch.column(key).to_numpy()
        if not len(k):
            continue
        starts = np.concatenate([[True], k[1:] != k[:-1]])
        first = np.maximum.accumulate(np.where(starts, np.arange(len(k)), 0))
        more = (first == 0) & (k[0] == last)
        arrays = list(batch.columns)
        for c in columns:
            x = batch.column(c).to_numpy()
            total = np.cumsum(x)
            total = total - (total - x)[first] + np.where(more, carried.get(c, 0), 0)
            arrays.append(pa.array(total))
            carried[c] = int(total[-1])
        last = k[-1]
        yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *[f"{c}_sum" for c in columns]])


def running_sums(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Adds <column>_sum for each of columns: its sum over the rows of the same key up to this one.

    rows is sorted over the whole table, by key first (orderBy); key is a long and not null, columns are longs that are not null.
    Each partition sums its own rows. Only the first and the last key of a partition can go on in another one, so
    what comes from partitions before is a table of at most two rows a partition, which is broadcast.
    """
    ship_package(rows.sparkSession)
    placed = cut(rows).withColumn("_part", F.spark_partition_id())
    schema = StructType(list(placed.schema.fields))
    for c in columns:
        schema = schema.add(f"{c}_sum", "long")
    out = placed.mapInArrow(partial(_sum, key=key, columns=columns), schema)
    edges = placed.groupBy("_part").agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("keys")).select(F.explode("keys").alias(key)).distinct()
    totals = placed.join(F.broadcast(edges), key).groupBy(key, "_part").agg(*[F.sum(c).alias(c) for c in columns])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), *[F.sum(c).over(earlier).alias(f"_{c}") for c in columns])
    out = out.join(F.broadcast(before), (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_of")), "left")
    return out.withColumns({f"{c}_sum": F.col(f"{c}_sum") + F.coalesce(f"_{c}", F.lit(0)) for c in columns}).drop("_part", "_key", "_of", *[f"_{c}" for c in columns])
