"""Token-sequence expressions over arrays of integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(ids: Column, lang_id: Column, eos_id: int, max_length: int) -> Column:
    """Language token, at most max_length - 2 tokens, end token."""
    return F.concat(F.array(lang_id), F.slice(ids, 1, max_length - 2), F.array(F.lit(eos_id)))


def pad(ids: Column, to: Column, value: int) -> Column:
    """Clipped or filled to a length."""
    return F.concat(F.slice(ids, F.lit(1), to), F.array_repeat(F.lit(value), F.greatest(F.lit(0), to - F.size(ids))))


def attention(ids: Column, to: Column) -> Column:
    kept = F.least(F.size(ids), to)
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), to - kept))


def mask_name(column: str) -> str:
    """The name of the mask that belongs to a column of ids."""
    stem = column.removesuffix("_ids")
    return "attention_mask" if stem == "input" else f"{stem}_attention_mask"


def rotate(ids: Column, offset: Column) -> Column:
    """The tokens between the first and the last moved left by offset, around."""
    n = F.size(ids) - 2
    k = F.when(n > 0, F.pmod(offset, n)).otherwise(0).cast("int")
    body = F.slice(ids, F.lit(2), F.greatest(n, F.lit(0)))
    turned = F.concat(F.slice(body, k + 1, F.greatest(n - k, F.lit(0))), F.slice(body, F.lit(1), k))
    return F.when(n < 2, ids).otherwise(F.concat(F.slice(ids, 1, 1), turned, F.slice(ids, -1, 1)))


def code_of_first(ids: Column, codes: dict[int, str]) -> Column:
    """The language that a sequence's first token stands for; null for another token or none."""
    named = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.try_element_at(named, F.get(ids, F.lit(0)))


def replace_ignored(ids: Column, pad_id: int, ignored: int = -100) -> Column:
    return F.transform(ids, lambda x: F.when(x == ignored, F.lit(pad_id)).otherwise(x))


def bucket(length: Column, bounds: list[int]) -> Column:
    """Number of the first bound that is at least length; one more than all for longer ones."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < length))
