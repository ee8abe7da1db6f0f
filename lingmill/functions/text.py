"""Text expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def n_chars(c: Column) -> Column:
    """Length in code points."""
    return F.char_length(c)


def dedup_key(c: Column) -> Column:
    """The key by which texts count as equal: lower case, without punctuation, symbols, control
    characters and digits, one space between words. Control characters go before white space is
    joined, so a tab joins its neighbours. Texts of nothing else have the empty key."""
    # what goes, goes by itself, so one pass takes it all; what is left of white space is joined then
    c = F.regexp_replace(F.lower(c), r"(?U)[[^\w\s]\x00-\x1F\x7F\d]+", "")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def one_line(c: Column) -> Column:
    return F.regexp_replace(c, "\n", " ")


def label(c: Column) -> Column:
    """A predicted label without the prefix that classifiers write."""
    return F.regexp_replace(c, "^__label__", "")


def lower_pair(source: Column, target: Column) -> Column:
    return F.lower(F.concat(source, F.lit("-"), target))


def canonical_pair(a: Column, b: Column) -> Column:
    """The name of an unordered pair."""
    return F.concat(F.least(a, b), F.lit("-"), F.greatest(a, b))


def code(iso_639_3: Column, iso_15924: Column) -> Column:
    """Null if either part is."""
    return F.concat(iso_639_3, F.lit("_"), iso_15924)


def optional(df, name: str, default: Column) -> Column:
    """A column, or a default where the frame doesn't have it."""
    return F.col(name) if name in df.columns else default
