"""Descriptive statistics per language."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import LANGUAGES, languages
from ..session import cut


def stack_sides(bitext: DataFrame, value: dict[str, F.Column]) -> DataFrame:
    """Both sides' (nllb_code, value) in one scan."""
    sides = F.array(*[F.struct(F.col(f"{s}_nllb_code").alias("nllb_code"), value[s].alias("value")) for s in ("source", "target")])
    return bitext.select(F.explode(sides).alias("x")).select("x.nllb_code", "x.value")


def describe(df: DataFrame, by: str = "nllb_code", value: str = "value", method: str = "exact") -> DataFrame:
    """count, null_count, mean, std, min, quartiles, max and total_count per group.

    exact quartiles are observed values (percentile_disc); approximate ones need bounded memory
    for any number of distinct values; by rounds they are exact with bounded memory, and df is read once a round.
    """
    v = F.col(value).cast("double")
    if method == "rounds":
        found = quantiles(df, by, value, (0.25, 0.5, 0.75)).groupBy(F.col(by).alias("_by")).pivot("point", [0.25, 0.5, 0.75]).agg(F.first("quantile")).toDF("_by", "p25", "p50", "p75")
        rest = df.groupBy(by).agg(F.count(v).alias("count"), F.count_if(v.isNull()).alias("null_count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count("*").alias("total_count"))
        return rest.join(found, F.col(by).eqNullSafe(F.col("_by"))).select(by, "count", "null_count", "mean", "std", "min", "p25", "p50", "p75", "max", "total_count")
    quartile = {
        "exact": lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY CAST(`{value}` AS DOUBLE))"),
        "approx": lambda p: F.percentile_approx(v, p, 10_000),
    }[method]
    return df.groupBy(by).agg(
        F.count(v).alias("count"), F.count_if(v.isNull()).alias("null_count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        *[quartile(p).cast("double").alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)], F.max(v).alias("max"), F.count("*").alias("total_count"),
    )


def quantiles(df: DataFrame, by: str, value: str, points: Sequence[float], *, bins: int = 1024) -> DataFrame:
    """by, point, quantile: the least value of a group that at least that share of its values don't pass (percentile_disc), exactly.

    Rounds of histograms narrow each group's interval to the bin that holds its rank, from the bin's least to its greatest value, until
    those are one value. What is shuffled is at most a row a group, point, bin and task, however many values a group has; no task holds
    a group's values. Nulls and NaN don't count; a group without values has a null quantile.
    """
    own = cut(df.select(F.col(by).alias("by"), F.col(value).cast("double").alias("v")))
    some = own.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in points]))
    ranks = some.groupBy("by").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).withColumn("point", wanted)
    left = cut(ranks.select("by", "point", "low", "high", F.greatest(F.lit(1), F.ceil(F.col("point") * F.col("n"))).cast("long").alias("rank")))
    found = None
    while True:
        done = left.filter("low = high")
        found = done if found is None else found.unionAll(done)
        left = left.filter("low < high")
        if not left.limit(1).count():
            break
        asked = left.select(F.col("by").alias("_by"), "point", "low", "high", "rank")
        # halves first, so that the width of any interval is finite
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        inside = some.join(F.broadcast(asked), F.col("by").eqNullSafe(F.col("_by"))).filter("v between low and high")
        counted = inside.groupBy("by", "point", "rank", F.least(F.lit(bins - 1), F.floor(share * bins)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("by", "point").orderBy("bin"))  # at most `bins` rows
        hit = counted.withColumn("upto", upto).filter("rank > upto - n and rank <= upto")
        left = cut(hit.select("by", "point", "low", "high", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")))
    groups = own.select("by").distinct().withColumn("point", wanted)
    out = groups.join(found.select(F.col("by").alias("_by"), F.col("point").alias("_p"), F.col("low").alias("quantile")), F.col("by").eqNullSafe(F.col("_by")) & (F.col("point") == F.col("_p")), "left")
    return out.select(F.col("by").alias(by), "point", "quantile")


def known(df: DataFrame, code: str = "nllb_code") -> DataFrame:
    return df.filter(F.col(code).isin(*LANGUAGES))


def unknown(df: DataFrame, code: str = "nllb_code") -> DataFrame:
    return df.filter(F.coalesce(~F.col(code).isin(*LANGUAGES), F.lit(True)))


def zero_filled(counts: DataFrame, count: str = "total_count") -> DataFrame:
    """A row for every known language, with 0 where counts has none."""
    return languages(counts.sparkSession).select("nllb_code").join(counts.select("nllb_code", count), "nllb_code", "left").select("nllb_code", F.coalesce(F.col(count), F.lit(0)).alias(count))
