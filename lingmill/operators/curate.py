"""Bitext curation: length features and filter, language-identification filters, deduplication, shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dedup_key, n_chars, strip
from ..registry import HIGH_RESOURCE

SIDES = ("source", "target")


def non_empty(df: DataFrame, a: str = "source_text", b: str = "target_text", *, strict: bool = True) -> DataFrame:
    """Rows with text on both sides; strict ignores white space. Null counts as empty."""
    clean = strip if strict else (lambda c: c)
    return df.filter((n_chars(clean(F.col(a))) > 0) & (n_chars(clean(F.col(b))) > 0))


def length_totals(df: DataFrame, code: str = "nllb_code", text: str = "sentence") -> DataFrame:
    return df.groupBy(code).agg(F.sum(n_chars(F.col(text))).cast("long").alias("total_length"), F.count(text).alias("n"))


def correction_factors(df: DataFrame, code: str = "nllb_code", text: str = "sentence", pivot: str = "eng_Latn") -> DataFrame:
    """Per language, the length of the pivot's texts over that of its own.

    One aggregation; the pivot's total comes from a window over the few language rows. Its absence is an error.
    """
    totals = length_totals(df, code, text)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.max(F.when(F.col(code) == pivot, F.col("total_length"))).over(everything)
    base = F.coalesce(base, F.raise_error(F.lit(f"no texts in {pivot}")).cast("long"))
    return totals.select(code, F.try_divide(base.cast("double"), F.col("total_length").cast("double")).alias("correction_ratio"))


def length_features(bitext: DataFrame, factors: DataFrame) -> DataFrame:
    """Adds each side's original_length, correction_ratio and corrected_length, and length_ratio.

    A language without a factor counts as 1; a null language has none. Factors have one row
    per language, so both joins are broadcast by their size.
    """
    for side in SIDES:
        f = factors.select(F.col("nllb_code").alias(f"_{side}_code"), F.col("correction_ratio").alias(f"_{side}_ratio"))
        bitext = bitext.join(f, F.col(f"{side}_nllb_code") == F.col(f"_{side}_code"), "left")
        ratio = F.when(F.col(f"{side}_nllb_code").isNotNull(), F.coalesce(f"_{side}_ratio", F.lit(1.0)))
        bitext = bitext.withColumn(f"{side}_correction_ratio", ratio).drop(f"_{side}_code", f"_{side}_ratio")
        bitext = bitext.withColumn(f"{side}_original_length", n_chars(F.col(f"{side}_text")))
        bitext = bitext.withColumn(f"{side}_corrected_length", F.col(f"{side}_original_length") * F.col(f"{side}_correction_ratio"))
    a, b = (F.col(f"{s}_corrected_length") for s in SIDES)
    return bitext.withColumn("length_ratio", F.try_divide(F.greatest(a, b), F.least(a, b)))


def length_filter(bitext: DataFrame, factors: DataFrame, *, max_ratio: float = 4.0, min_length: int = 15) -> DataFrame:
    """Pairs both of whose texts are long enough and whose corrected lengths are near enough. Columns stay as they were."""
    long_enough = bitext.filter((n_chars(F.col("source_text")) >= min_length) & (n_chars(F.col("target_text")) >= min_length))
    return length_features(long_enough, factors).filter(F.col("length_ratio") <= max_ratio).select(*bitext.columns)


def lid_resolve(bitext: DataFrame, predict: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Fills sides that have no score yet from predict[side] = (label, score).

    A side with a score keeps it and its declared language; a prediction without a label is
    `unknown` at 0. One projection covers all four patterns of missing scores.
    """
    for side in SIDES:
        label, score = predict[side]
        missing = F.col(f"{side}_lid").isNull()
        bitext = bitext.withColumn(f"{side}_lid_predicted", F.when(missing, F.coalesce(label, F.lit("unknown"))).otherwise(F.col(f"{side}_nllb_code")))
        bitext = bitext.withColumn(f"{side}_lid", F.when(missing, F.coalesce(score, F.lit(0.0))).otherwise(F.col(f"{side}_lid")).cast("float"))
    return bitext


def lid_agrees(df: DataFrame) -> DataFrame:
    return df.filter((F.col("source_lid_predicted") == F.col("source_nllb_code")) & (F.col("target_lid_predicted") == F.col("target_nllb_code")))


def lid_confident(df: DataFrame, minimum: float = 0.5) -> DataFrame:
    return df.filter((F.col("source_lid") > minimum) & (F.col("target_lid") > minimum))


def lid_high_resource(df: DataFrame, minimum: float = 0.95, languages: Sequence[str] = HIGH_RESOURCE) -> DataFrame:
    """Languages with much data must pass a stricter minimum, each side for itself."""
    side = lambda s: (F.col(f"{s}_lid") > minimum) | ~F.col(f"{s}_nllb_code").isin(*languages)
    return df.filter(side("source") & side("target"))


def lid_filter(df: DataFrame, minimum: float = 0.5, high: float = 0.95, languages: Sequence[str] = HIGH_RESOURCE) -> DataFrame:
    return lid_high_resource(lid_confident(lid_agrees(df), minimum), high, languages)


def first_of(df: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The first row in order of each key.

    An aggregation whose partial minimum runs before the shuffle, so a key that a third of all
    rows share costs no more than others; a window would send them all to one task. Nulls are
    equal as keys and first in order; remaining columns break ties.
    """
    rest = [c for c in df.columns if c not in order]
    row = F.struct(*[F.col(f"`{c}`") for c in (*order, *rest)])
    return df.groupBy(*[k.alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.min(row).alias("_row")).select(*[F.col(f"_row.`{c}`") for c in df.columns])


def dedup(df: DataFrame, direction: str = "both", *, order: Sequence[str] = ("id",), keep_empty_keys: bool = False) -> DataFrame:
    """Pairs whose normalised source text (then, of the rest, target text) is new for the other side's language.

    order must be a total order for the result to be determined. Texts that normalise to
    nothing share the empty key, unless keep_empty_keys leaves such rows alone.
    """
    if direction not in ("source", "target", "both"):
        raise ValueError(f"no such direction: {direction}")
    for side, other in (("source", "target"), ("target", "source")):
        if direction in (side, "both"):
            key = dedup_key(F.col(f"{side}_text"))
            if keep_empty_keys:
                own = df.filter(key == "")
                df = first_of(df.filter(F.coalesce(key != "", F.lit(True))), [key, F.col(f"{other}_nllb_code")], order).unionByName(own)
            else:
                df = first_of(df, [key, F.col(f"{other}_nllb_code")], order)
    return df


def drop_duplicates_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_of(df, [F.col(k) for k in keys], order)


def shard_of(key: Column, shards: int) -> Column:
    """A shard by the first 32 bits of the key's MD5, which any engine can state; null keys go to shard 0."""
    number = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.pmod(number, F.lit(shards)), F.lit(0)).cast("int")


def rows_per_shard(n: int, shards: int) -> int:
    return max(1, -(-n // shards))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """In an order that only the key and the seed decide: dealt by a hash, then sorted by it in
    each partition. No range sampling, so the input is read once."""
    order = F.xxhash64(F.col(key), F.lit(seed))
    return df.repartition(order).sortWithinPartitions(order, key)


def report(before: Column, after: Column) -> list[Column]:
    """What a stage kept, as percentages."""
    return [F.round(F.try_divide(100.0 * after, before), 2).alias("retention"), F.round(F.try_divide(100.0 * (before - after), before), 2).alias("reduction")]
