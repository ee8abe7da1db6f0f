"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ensure_checkpoint_dir, ship_package
from ..session import load as table

__all__ = ["ascii_lower", "cut", "ensure_checkpoint_dir", "n_space_words", "ship_package", "small_side", "table", "text_of", "trim", "unused_names"]


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def trim() -> None:
    """Give freed memory back to the system. Python workers wait idle between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc()(0)


def text_of(col: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(col), F.lit(""))


#: A-Z only, whatever the locale.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


#: Words that white space of ASCII delimits.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def n_space_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(SPACE_WORD)).cast("long")


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes for no column of df to have them."""
    there = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in there:
            name = f"_{name}"
        out.append(name)
        there.add(name.lower())
    return out


def small_side(df: DataFrame, most: int = 16_000_000) -> DataFrame:
    """df with a broadcast hint if its rows, counted here, hold at most `most` bytes; else as it is, for a shuffled join."""
    held = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    bytes_ = sum(held, F.lit(0).cast("long")) + 16 * len(df.columns)
    return F.broadcast(df) if (df.agg(F.sum(bytes_).alias("n")).first().n or 0) <= most else df
