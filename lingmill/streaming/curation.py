"""Incremental extensions: the batch expressions over Structured Streaming sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import dedup_key


def curate_files(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Takes in new Parquet files of a folder, each once, through a narrow batch transform."""
    return transform(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(events: DataFrame, text: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first arrival of each normalised text within a watermark; later ones inside it go."""
    return events.withColumn("_key", dedup_key(F.col(text))).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def tumbling_stats(events: DataFrame, time: str, value: str, by: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """count and mean of a value per group and window."""
    own = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return own.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), by, "n", "mean")
