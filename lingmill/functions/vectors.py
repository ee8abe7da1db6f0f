"""Vector expressions over array columns, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(a: Column) -> Column:
    """Of length one; a zero vector stays zero."""
    n = norm(a)
    by = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.transform(a, lambda x: x.cast("double") / by)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_error(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def pool(tokens: Column, mask: Column, how: str) -> Column:
    """One vector from an array of token vectors. mean and max use unmasked tokens only; cls and
    last take the first and the last token whatever the mask; none keeps them all."""
    if how == "none":
        return tokens
    if how in ("cls", "last"):
        return F.try_element_at(tokens, F.lit(1 if how == "cls" else -1))
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["t"])
    dims = F.sequence(F.lit(1), F.size(F.element_at(tokens, 1)))
    if how == "mean":
        return F.transform(dims, lambda d: F.aggregate(kept, F.lit(0.0), lambda s, t: s + F.element_at(t, d).cast("double")) / F.size(kept))
    if how == "max":
        return F.transform(dims, lambda d: F.array_max(F.transform(kept, lambda t: F.element_at(t, d).cast("double"))))
    raise ValueError(f"no such pooling: {how}")
