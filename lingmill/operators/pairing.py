"""Language pairings of multi-parallel data, and the mined-corpus transform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import optional, strip
from .curate import first_of, non_empty
from .ordering import number_rows


def mined_transform(raw: DataFrame, source: tuple[str, str], target: tuple[str, str], *, order: list[str], dataset: str = "allenai", first_id: int = 0) -> DataFrame:
    """A raw mined frame to the ingest schema. source and target are (field of the translation struct, code).

    Ids number the raw rows in `order`, before empty pairs go, so they have gaps. Columns that
    a corpus lacks get an empty string, or null for scores.
    """
    named = {}
    for side, (field, code) in (("source", source), ("target", target)):
        prefix = f"{side}_sentence_"
        named[f"{side}_nllb_code"] = F.lit(code)
        named[f"{side}_text"] = strip(F.col("translation").getField(field))
        named[f"{side}_lid"] = optional(raw, prefix + "lid", F.lit(None)).cast("float")
        for extra in ("url", "source"):
            named[f"{side}_{extra}"] = strip(optional(raw, prefix + extra, F.lit("")))
    stem = f"{dataset}_{source[1]}-{target[1]}_"
    numbered = number_rows(raw, order, "_number", first_id)
    out = numbered.select(*[c.alias(n) for n, c in named.items()], optional(raw, "laser_score", F.lit(None)).cast("float").alias("laser_score"), F.lit(dataset).alias("dataset"), F.concat(F.lit(stem), F.col("_number").cast("string")).alias("id"))
    return non_empty(out)


def frequent(df: DataFrame, code: str, min_samples: int) -> DataFrame:
    """Rows of languages with more than min_samples rows. A language is one row of what is broadcast, so its texts aren't dealt by it."""
    many = df.groupBy(code).agg(F.count("*").alias("_n")).filter(F.col("_n") > min_samples).select(code)
    return df.join(F.broadcast(many), code, "left_semi")


def seed_pairs(seed: DataFrame, *, min_samples: int = 0, dataset: str = "seed") -> DataFrame:
    """Every unordered language pairing of a multi-parallel corpus seed(id, text, url, nllb_code), by one self-join on id."""
    own = frequent(seed, "nllb_code", min_samples)
    a = own.select(F.col("id").alias("_id"), F.col("nllb_code").alias("source_nllb_code"), F.col("text").alias("source_text"), F.col("url").alias("source_url"))
    b = own.select(F.col("id").alias("_other"), F.col("nllb_code").alias("target_nllb_code"), F.col("text").alias("target_text"), F.col("url").alias("target_url"))
    both = a.join(b, (F.col("_id") == F.col("_other")) & (F.col("source_nllb_code") < F.col("target_nllb_code")))
    name = F.concat(F.lit(f"{dataset}."), F.col("source_nllb_code"), F.lit("-"), F.col("target_nllb_code"), F.lit("."), F.col("_id").cast("string"))
    return non_empty(both.withColumn("id", name).withColumn("dataset", F.lit(dataset)).drop("_id", "_other"), strict=False)


def flores_pairs(sentences: DataFrame, *, by: list[str], pivot: str = "eng_Latn", dedup: bool = True) -> DataFrame:
    """Directed pairs of parallel sentences(*by, nllb_code, sentence): with the pivot on either side, or of a language with itself.

    Ids below zero are hard negatives and take no part. dedup keeps the first row of each text pair.
    """
    own = sentences.filter("id >= 0") if "id" in sentences.columns else sentences
    a = own.select(*by, F.col("nllb_code").alias("source_nllb_code"), F.col("sentence").alias("source_text"))
    b = own.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("nllb_code").alias("target_nllb_code"), F.col("sentence").alias("target_text"))
    same = None
    for c in by:
        test = F.col(c) == F.col(f"_{c}")
        same = test if same is None else same & test
    s, t = F.col("source_nllb_code"), F.col("target_nllb_code")
    out = a.join(b, same & ((s == pivot) | (t == pivot) | (s == t))).drop(*[f"_{c}" for c in by])
    keys = ["source_nllb_code", "target_nllb_code", "source_text", "target_text"]
    return first_of(out, [F.col(k) for k in keys], by) if dedup else out


def hard_negative_ids(sentences: DataFrame, order: list[str]) -> DataFrame:
    """Numbers synthetic negatives -1, -2 and so on in order."""
    return number_rows(sentences, order, "_number").withColumn("id", -F.col("_number") - 1).drop("_number")


def backtranslation_worklist(seed: DataFrame, languages: DataFrame, pivot: str = "eng_Latn") -> DataFrame:
    """Every pivot text for every language that seed(nllb_code, id, text) lacks, longest first.

    languages is a registry of bounded size, so the product grows with the texts alone.
    """
    missing = languages.select(F.col("nllb_code").alias("target_nllb_code")).join(seed.select(F.col("nllb_code").alias("target_nllb_code")).distinct(), "target_nllb_code", "left_anti")
    texts = seed.filter(F.col("nllb_code") == pivot).select(F.col("nllb_code").alias("source_nllb_code"), "id", F.col("text").alias("source_text"))
    length = F.char_length("source_text")
    return texts.crossJoin(missing).withColumn("length", length).orderBy(F.desc("length"), F.desc("source_nllb_code"), F.desc("target_nllb_code"), F.desc("id"))


def next_row_pairs(df: DataFrame, key: str, position: str, text: str, first: Column) -> DataFrame:
    """Each row that meets `first` beside the one after it: (key, position, source_text, target_text)."""
    w = Window.partitionBy(key).orderBy(position)
    return df.withColumn("target_text", F.lead(text).over(w)).withColumn("_next", F.lead(position).over(w)).filter(first & (F.col("_next") == F.col(position) + 1)).select(key, position, F.col(text).alias("source_text"), "target_text")


def aligned(a: DataFrame, b: DataFrame, a_text: str, b_text: str, line: str = "line") -> DataFrame:
    """Two line streams beside each other by line number. Streams of different lengths are an error, not a shorter result."""
    full = a.select(F.col(line), F.col(a_text).alias("source_text")).join(b.select(F.col(line).alias("_line"), F.col(b_text).alias("target_text")), F.col(line) == F.col("_line"), "full")
    check = F.when(F.col(line).isNull() | F.col("_line").isNull(), F.raise_error(F.lit("the files have different numbers of lines")).cast("string"))
    return full.select(line, F.coalesce(check, F.col("source_text")).alias("source_text"), "target_text")
