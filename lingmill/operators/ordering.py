"""Row numbers over a whole table or within groups, without sorting anything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_IN_PARTITION = (1 << 33) - 1


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """Adds `name`: start, start + 1 and so on in order.

    The sorted table is checkpointed, which fixes its partitions; a row's number is its place
    in its partition plus the rows of the partitions before, of which there is one count each.
    """
    part = F.spark_partition_id()
    placed = cut(df.orderBy(*order)).withColumn("_part", part).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_part").alias("_of"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), F.col("_part") == F.col("_of")).withColumn(name, F.col("_before") + F.col("_at") + start).drop("_part", "_at", "_of", "_before")


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Adds `name`: 0, 1 and so on in order within each group of keys. A group of any size is spread over tasks;
    groups are few (languages, buckets), since their first numbers are broadcast."""
    rows = number_rows(df, [*keys, *order], "_number")
    first = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("_number").alias("_first"))
    same = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = test if same is None else same & test
    return rows.join(F.broadcast(first), same).withColumn(name, F.col("_number") - F.col("_first")).drop("_number", "_first", *[f"_{k}" for k in keys])
