"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets come from water filling over sources, by rounds of sums. Whole epochs of a source come first: a target
of 1.3 times a source takes every document once and then a sample of 0.3. The sample sorts
documents by the exponential key -ln(u) / quality, u being a hash of doc_id and text, and takes them
while the prefix sum of sizes stays within the rest of the target.

The place where a source's sample ends is found by rounds of cells: keys of the open interval are
counted in cells of equal width, the prefix sum of cells picks the one where the budget ends, and that is the next
interval, until it holds at most `cell_rows` rows or a single key. In it documents are offered
in key order and each that still fits is taken; equal rows count as one with a number. A hot source is thus never sorted in one task,
whatever its qualities, and sources are never gathered in one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import number_rows
from .common import cut, n_space_words, ship_package, small_side, text_of

#: Code points of letters, for the share of letters in a text.
_NON_LETTERS = r"[^\p{L}]+"


def quality(text) -> F.Column:
    """A weight from 0.25 to 1: the share of characters that are letters (empty text: 0.25)."""
    n = F.length(text)
    share = F.length(F.regexp_replace(text, _NON_LETTERS, "")) / F.greatest(n, F.lit(1))
    return F.greatest(F.lit(0.25), F.round(share, 6))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sizes(source, source_size, ...), one row per source, with `target` added.

    Sources that the water reaches above their cap are full and drop out; the others share what is left by weight, until no more
    become full. Each round is one row of sums, so there may be any number of sources.
    """
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__no"), F.lit(len(weights))) + 1).cast("int"))
    s = number_rows(sizes, [F.col("source").isNull(), "source"], "__no")
    s = cut(s.withColumn("__weight", pick).withColumn("__most", F.col("source_size") * F.lit(float(cap))).withColumn("__level", F.col("__most") / F.col("__weight")))
    budget = (s.agg(F.sum("source_size").alias("n")).first().n or 0) * float(share)
    water, full = -1.0, 0
    while True:
        below = F.col("__level") <= water
        row = s.agg(F.count(F.when(below, 1)).alias("full"), F.sum(F.when(below, F.col("__most"))).alias("held"), F.sum(F.when(~below, F.col("__weight"))).alias("rest")).first()
        if row.rest is None or water >= 0 and row.full == full:
            break
        full, water = row.full, max(0.0, (budget - (row.held or 0.0)) / row.rest)
    target = F.least(F.col("__most"), F.col("__weight") * F.lit(water)) if row.rest else F.col("__most")
    return s.withColumn("target", target).drop("__no", "__weight", "__most", "__level")


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """In key order, each document that still fits is taken: `takes` of the `rows` equal ones."""
    pdf = pdf.sort_values(["key", "id", "size"], kind="stable", na_position="last")
    left = float(pdf["room"].iloc[0])
    takes = []
    for n, rows in zip(pdf["size"].tolist(), pdf["rows"].tolist()):
        k = rows if n == 0 else min(rows, max(0, math.floor(left / n)))
        takes.append(k)
        left -= k * n
    return pdf.assign(takes=takes)[["id", "size", "source", "key", "rows", "takes"]]


def _keyed(docs: DataFrame, seed: int, whole: bool) -> DataFrame:
    """(id, source, size, key[, row]): what mixing needs of docs, and the whole row as one value, so that no names clash."""
    text = text_of()
    own = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text, F.lit(seed))
    u = (F.pmod(own, F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    return docs.select(F.col("doc_id").alias("id"), "source", n_space_words(text).alias("size"), (-F.log(u) / quality(text)).alias("key"), *row)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _plan(rows: DataFrame, weights: Sequence[float], share: float, cap: float, cell_rows: int, cells: int = 1024) -> DataFrame:
    """One row per source: of, source_size, target, epochs, and the interval of keys [low, high] in which its sample ends with the room left there."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    goal = targets(per, weights, share, cap).withColumnRenamed("source", "of")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = cut(goal.withColumn("room", F.col("target") - F.col("epochs") * F.col("source_size")))
    wide = (F.col("n") > cell_rows) & (F.col("low") < F.col("high"))
    while goal.filter(wide).limit(1).count():
        inside = rows.join(goal.filter(wide).select("of", "low", "high", "room"), _same("source", "of") & F.col("key").between(F.col("low"), F.col("high")))
        cell = F.least(F.lit(cells - 1), F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * cells)).cast("int")
        sums = inside.groupBy(F.col("of").alias("source"), cell.alias("cell")).agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"), F.first("room").alias("room"))
        # at most `cells` rows a source
        before = F.sum("size").over(Window.partitionBy("source").orderBy("cell")) - F.col("size")
        ends = sums.withColumn("left", F.col("room") - before).filter(F.col("left") < F.col("size"))
        ends = ends.groupBy("source").agg(F.min(F.struct("cell", "low", "high", "n", "left")).alias("e")).select("source", "e.*")
        facts = [F.col(c) for c in ("of", "source_size", "target", "epochs")]
        # a source without such a cell is taken whole: its interval is empty and above every key
        above = lambda c, none: F.coalesce(F.col(f"e.{c}"), F.lit(none))
        next_ = goal.filter(wide).alias("g").join(ends.alias("e"), F.col("g.of").eqNullSafe(F.col("e.source")), "left")
        next_ = next_.select(*facts, above("left", 0.0).alias("room"), above("low", float("inf")).alias("low"), above("high", float("inf")).alias("high"), above("n", 0).alias("n"))
        goal = cut(goal.filter(~wide).select(*next_.columns).unionByName(next_))
    return goal.drop("n")


def _decided(rows: DataFrame, narrow: DataFrame, goal: DataFrame) -> DataFrame:
    """rows of _keyed beside their source's plan, with `times`, how often the mix takes each.

    narrow: the same rows without `row`. The rows of the intervals where samples end, at most cell_rows different ones a source, are decided from these alone.
    """
    plan = small_side(goal)  # else both sides of the join, texts too, are shuffled before their sizes are known
    planned = lambda df: df.join(plan, _same("source", "of"))
    at_end = F.col("key").between(F.col("low"), F.col("high"))
    edge = planned(narrow).filter(at_end).groupBy("source", "id", "size", "key").agg(F.count("*").alias("rows"), F.first("room").alias("room"))
    schema = edge.drop("room").select("id", "size", "source", "key", "rows").schema.add("takes", "long")
    takes = cut(edge.groupBy("source").applyInPandas(_fill, schema))
    takes = small_side(takes.select(*[F.col(c).alias(f"{c}_t") for c in takes.columns]))
    base = [c for c in (*rows.columns, "source_size", "target", "epochs")]
    flat = planned(rows).filter(~at_end).withColumn("extra", (F.col("key") < F.col("low")).cast("long")).select(*base, "extra")
    same = _same("source", "source_t") & _same("id", "id_t") & (F.col("size") == F.col("size_t")) & (F.col("key") == F.col("key_t"))
    close = planned(rows).filter(at_end).join(takes, same)
    # of equal rows of which only some are taken, the first so many; other rows need no number and are spread
    some = (F.col("takes_t") > 0) & (F.col("takes_t") < F.col("rows_t"))
    number = F.row_number().over(Window.partitionBy("source", "id", "size", "key", F.when(some, -1).otherwise(F.col("spread"))).orderBy(F.lit(1)))
    close = close.withColumn("spread", F.pmod(F.monotonically_increasing_id(), F.lit(4096))).withColumn("number", number)
    taken = F.when(some, F.col("number") <= F.col("takes_t")).otherwise(F.col("takes_t") > 0)
    return flat.unionByName(close.withColumn("extra", taken.cast("long")).select(*base, "extra")).withColumn("times", F.col("epochs") + F.col("extra"))


_OPTIONS = {"weights": (5, 2, 1), "share": 1.5, "cap": 2.0, "seed": 7, "cell_rows": 512}


def _goal(docs: DataFrame, options: dict) -> tuple[DataFrame, DataFrame, int]:
    o = _OPTIONS | options
    ship_package(docs.sparkSession)
    # one pass over the texts; from here rows are a few numbers wide
    narrow = cut(_keyed(docs, o["seed"], False))
    return narrow, _plan(narrow, o["weights"], o["share"], o["cap"], o["cell_rows"]), o["seed"]


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, epochs, times, taken.

    Options: weights, share, cap, seed, cell_rows. taken is size times the number of times the
    mix takes the document. Null texts and texts without words have size 0 and take 0 words; texts may be of any length. A
    null source is a source of its own, last. Null doc_ids are drawn for by their texts. Repeated rows are documents of their own, which
    of them are taken doesn't matter. An empty table gives an empty one. Only doc_id, text and source are read.
    """
    narrow, goal, _ = _goal(docs, options)
    out = _decided(narrow, narrow, goal)
    return out.select(F.col("id").alias("doc_id"), "size", "source", "source_size", "target", "epochs", "times", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Whole rows of docs, each as often as the mix takes it. Texts are shuffled only where a source's sample ends.

    Columns of any name stay as they are, whatever the ones used here; edge cases are those of `mix`.
    """
    narrow, goal, seed = _goal(docs, options)
    out = _decided(_keyed(docs, seed, True), narrow, goal).filter("times > 0")
    out = out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mixing_query(docs: DataFrame) -> DataFrame:
    """The contract's columns of `mix` over every row of docs, whose edge cases hold."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
