"""Shaping sequences into batches: buffer sorting, length buckets, padding, pair expansion."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import attention, bucket, pad
from .ordering import number_rows, number_within


def buffer_sort(df: DataFrame, position: str, buffer: int, length: Column) -> DataFrame:
    """Consecutive runs of `buffer` rows, each by falling length; equal lengths keep their order."""
    return df.withColumn("buffer", F.floor(F.col(position) / buffer)).withColumn("rank", F.row_number().over(Window.partitionBy("buffer").orderBy(length.desc(), position)))


def lognormal_bounds(count: int, max_length: float, sigma: float = 1.0) -> list[float]:
    """Quantiles i / (count + 1) of a log-normal law, scaled so that the last is max_length."""
    q = [math.exp(sigma * NormalDist().inv_cdf(i / (count + 1))) for i in range(1, count + 1)]
    return [x * max_length / q[-1] for x in q]


def check_bounds(bounds: Sequence[float]) -> list[float]:
    if any(b < 0 for b in bounds) or list(bounds) != sorted(set(bounds)):
        raise ValueError("bucket bounds must be non-negative, different and rising")
    return list(bounds)


def caps(bounds: Sequence[float], max_batch_length: float, max_examples: int | None = None) -> list[int]:
    """Examples per batch of each bucket; 1 for the overflow bucket."""
    each = [max(1, int(max_batch_length / b)) for b in bounds]
    return [min(c, max_examples) if max_examples else c for c in each] + [1]


def dynamic_batches(df: DataFrame, bounds: Sequence[float], max_batch_length: float, *, length: str = "length", order: str = "id", max_examples: int | None = None, drop_last: bool = False) -> DataFrame:
    """Adds bucket and batch: consecutive rows of a length bucket, as many as its cap."""
    bounds = check_bounds(bounds)
    cap = F.element_at(F.array(*map(F.lit, caps(bounds, max_batch_length, max_examples))), F.col("bucket") + 1)
    df = df.withColumn("bucket", bucket(F.col(length), list(bounds))).withColumn("cap", cap)
    df = number_within(df, ["bucket"], [order], "_place").withColumn("batch", F.floor(F.col("_place") / F.col("cap"))).drop("_place")
    if drop_last:
        df = df.withColumn("_n", F.count("*").over(Window.partitionBy("bucket", "batch"))).filter("_n = cap").drop("_n")
    return df


def bucket_stats(df: DataFrame, length: str = "length") -> DataFrame:
    """Per bucket: rows, shortest, longest, total, padding factor and whole batches. Needs dynamic_batches' columns."""
    return df.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min(length).alias("min_len"), F.max(length).alias("max_len"), F.sum(length).cast("long").alias("total"),
        F.round(F.try_divide((F.max(length) - F.min(length)).cast("double"), F.avg(length)), 6).alias("pad_factor"),
        F.floor(F.count("*") / F.max("cap")).cast("long").alias("num_batches"),
    )


def batch_padding(df: DataFrame, length: str = "length") -> DataFrame:
    """Per batch: total length, padding and its percentage."""
    total, full = F.sum(length).cast("long"), (F.max(length) * F.count("*")).cast("long")
    return df.groupBy("bucket", "batch").agg(total.alias("total"), (full - total).alias("padding"), F.round(F.try_divide(100.0 * (full - total), full.cast("double")), 6).alias("padding_pct"))


def batch_order(df: DataFrame, how: str, *, seed: int = 42, epoch: int = 0, length: str = "length") -> DataFrame:
    """Numbers batches: by falling or rising longest length, or at random as seed and epoch decide."""
    batches = df.groupBy("bucket", "batch").agg(F.max(length).alias("max_len"))
    order = {"descending": [F.desc("max_len")], "ascending": [F.asc("max_len")], "random": [F.xxhash64("bucket", "batch", F.lit(seed + epoch))]}[how]
    return number_rows(batches, [*order, "bucket", "batch"], "position")


def rank_shard(df: DataFrame, position: str, world: int, rank: int) -> DataFrame:
    """What one of `world` workers takes: every world-th position, wrapped around so that all take as many."""
    own = df.crossJoin(F.broadcast(df.agg((F.max(position) + 1).cast("long").alias("_n"))))  # one row
    p = F.col(position).cast("long")
    last = F.greatest((F.ceil(F.col("_n") / world) * world).cast("long") - 1, p)
    return own.withColumn("slot", F.explode(F.sequence(p, last, F.col("_n")))).drop("_n").filter(F.pmod("slot", F.lit(world)) == rank)


def pad_batch(df: DataFrame, columns: dict[str, int], batch: Sequence[str], max_length: int) -> DataFrame:
    """Pads each array column to its batch's longest, at most max_length, and adds its mask. columns: name -> padding value."""
    for name, value in columns.items():
        to = F.least(F.max(F.size(name)).over(Window.partitionBy(*batch)), F.lit(max_length))
        df = df.withColumn(f"{name}_to", to).withColumn(f"{name}_mask", attention(F.col(name), F.col(f"{name}_to"))).withColumn(name, pad(F.col(name), F.col(f"{name}_to"), value)).drop(f"{name}_to")
    return df


def expand_pairs(df: DataFrame, denoise: Column, source: str = "source_ids", target: str = "target_ids", noise=lambda c: c, whole: Column | None = None) -> DataFrame:
    """Each row twice: both sides rebuilt from their noised selves where denoise holds, else both directions.
    Evaluation rows, where `whole` holds, pass through once, without an mse."""
    x, y = F.col(source), F.col(target)
    two = F.when(denoise, F.array(F.struct(noise(x).alias("input_ids"), x.alias("labels"), F.lit(0).alias("mse")), F.struct(noise(y).alias("input_ids"), y.alias("labels"), F.lit(0).alias("mse"))))
    two = two.otherwise(F.array(F.struct(x.alias("input_ids"), y.alias("labels"), F.lit(1).alias("mse")), F.struct(y.alias("input_ids"), x.alias("labels"), F.lit(1).alias("mse"))))
    if whole is not None:
        two = F.when(whole, F.array(F.struct(x.alias("input_ids"), y.alias("labels"), F.lit(None).cast("int").alias("mse")))).otherwise(two)
    return df.select(*[c for c in df.columns if c not in (source, target)], F.posexplode(two).alias("side", "_p")).select("*", "_p.input_ids", "_p.labels", "_p.mse").drop("_p")


def gather(df: DataFrame, indices: DataFrame, position: str = "pos") -> DataFrame:
    """Rows at the positions that indices(pos, ...) name, as often as named."""
    return indices.join(df, position)


def length_between(df: DataFrame, length: str, min_seconds: float = 0.0, max_seconds: float = 20.0, rate: int = 16_000) -> DataFrame:
    """Audio strictly between two durations."""
    return df.filter((F.col(length) > min_seconds * rate) & (F.col(length) < max_seconds * rate))
