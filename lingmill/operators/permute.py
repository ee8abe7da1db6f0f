"""Permutations of a whole table without a sort: a keyed bijection of row numbers.

Row i of n stands at place p(i) in an epoch's order. p is a Feistel network over pairs: i is (i // b, i % b) in a grid of a x b cells, a * b
at least n and less than n + a; each round adds to one half a function of the other, modulo its size. Cells beyond n are walked on
from until one below n comes, which keeps it a bijection of 0 to n - 1. So the place of any row, and the row at any
place, are arithmetic on a number, the seed and the epoch: nothing is drawn, stored or moved.

The rounds use plain whole-number arithmetic, so that SQL can state them too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import number_rows

PRIME = (1 << 31) - 1
ROUNDS = 6
#: Less than one cell in b lies beyond n, and fewer than a in all: so many walks always end for n up to 225, and beyond that but for a chance under 10^-18 a row, which raises an error.
WALKS = 16


@dataclass(frozen=True)
class Permutation:
    """A bijection of 0 to n - 1, one for each seed and epoch; n is less than 2^52."""

    n: int
    seed: int = 42
    epoch: int = 0

    def __post_init__(self):
        if not 0 <= self.n < 1 << 52:
            raise ValueError("n must be from 0 to 2^52 - 1")

    @property
    def sides(self) -> tuple[int, int]:
        a = math.isqrt(max(1, self.n) - 1) + 1
        return a, -(-max(1, self.n) // a)

    def keys(self) -> list[tuple[int, int, int]]:
        """Three numbers below PRIME for each round."""
        out = []
        for r in range(ROUNDS):
            raw = hashlib.sha256(f"{self.seed}/{self.epoch}/{r}".encode()).digest()
            out.append(tuple(1 + int.from_bytes(raw[8 * k : 8 * k + 8], "little") % (PRIME - 1) for k in range(3)))
        return out

    def _steps(self) -> list[tuple[int, int, tuple[int, int, int]]]:
        """(which half changes, its size, keys) of each round."""
        return [(r % 2, self.sides[r % 2], keys) for r, keys in enumerate(self.keys())]

    @staticmethod
    def _turn(halves, mod, step, sign: int):
        """A round over two halves, numbers or columns; sign -1 undoes it."""
        which, size, (k0, k1, k2) = step
        y = mod(mod(halves[1 - which], PRIME) * k0 + k1, PRIME)
        moved = mod(halves[which] + sign * mod(mod(mod(y * y, PRIME) * k2 + k0, PRIME), size) + size, size)
        return (halves[0], moved) if which else (moved, halves[1])

    def _number(self, i: int, sign: int) -> int:
        if not 0 <= i < self.n:
            raise ValueError(f"{i} is not from 0 to {self.n - 1}")
        b, steps = self.sides[1], self._steps()[::sign]
        while True:
            halves = divmod(i, b)
            for step in steps:
                halves = self._turn(halves, lambda x, m: x % m, step, sign)
            i = halves[0] * b + halves[1]
            if i < self.n:
                return i

    def place_of(self, row: int) -> int:
        return self._number(row, 1)

    def row_at(self, place: int) -> int:
        return self._number(place, -1)

    def _column(self, i: Column, sign: int) -> Column:
        b, steps = self.sides[1], self._steps()[::sign]
        mod = lambda x, m: F.pmod(x, F.lit(m).cast("long"))

        def once(x: Column) -> Column:
            # a round reads the halves more than once, so they are bound as an array's only element
            out = F.array(F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), mod(x, b).alias("r")))
            for step in steps:
                turned = lambda v, step=step: self._turn((v["l"], v["r"]), mod, step, sign)
                out = F.transform(out, lambda v: F.struct(*[h.alias(n) for h, n in zip(turned(v), "lr")]))
            return F.get(F.transform(out, lambda v: v["l"] * F.lit(b) + v["r"]), F.lit(0))

        walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.lit(-1).cast("long"), lambda acc, k: F.when((acc >= 0) & (acc < self.n), acc).otherwise(once(F.when(acc < 0, i).otherwise(acc))))
        return F.when(walked < self.n, walked).otherwise(F.raise_error(F.lit("a walk did not end")).cast("long"))

    def places(self, row: Column) -> Column:
        """Where a row stands; null for null."""
        return F.when(row.isNotNull(), self._column(row.cast("long"), 1))

    def rows(self, place: Column) -> Column:
        """Which row stands at a place; null for null."""
        return F.when(place.isNotNull(), self._column(place.cast("long"), -1))

    def sql(self, i: str, a: str = "a", b: str = "b") -> str:
        """One walk of `places` over a BIGINT, as a SQL expression; a and b are the sides. It doesn't depend on n but by them."""
        left, right = f"({i} // {b})", f"({i} % {b})"
        for r, (k0, k1, k2) in enumerate(self.keys()):
            other, size = (left, b) if r % 2 else (right, a)
            y = f"list_transform([(({other} % {PRIME}) * {k0} + {k1}) % {PRIME}], lambda y : (((y * y) % {PRIME}) * {k2} + {k0}) % {PRIME})[1]"
            moved = f"(({right if r % 2 else left} + {y} % {size} + {size}) % {size})"
            left, right = (left, moved) if r % 2 else (moved, right)
        return f"({left} * {b} + {right})"


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "row") -> tuple[DataFrame, int]:
    """df with its row numbers by order, which must tell rows apart, and how many there are."""
    rows = number_rows(df, order, name)
    return rows, rows.count()


def permuted(rows: DataFrame, n: int, row: str = "row", *, seed: int = 42, epoch: int = 0, name: str = "place") -> DataFrame:
    """rows, numbered from 0 to n - 1, with their places in an epoch's order. No shuffle."""
    return rows.withColumn(name, Permutation(n, seed, epoch).places(F.col(row)))


def window_of(rows: DataFrame, n: int, start: int, end: int, row: str = "row", *, seed: int = 42, epoch: int = 0, name: str = "place") -> DataFrame:
    """The rows at places start to end - 1 of an epoch, such as a step's batch: their numbers are computed, not searched for."""
    wanted = rows.sparkSession.range(max(0, start), min(end, n)).select(F.col("id").alias(name), Permutation(n, seed, epoch).rows(F.col("id")).alias(row))
    return rows.join(wanted, row)


def written_order(rows: DataFrame, n: int, path: str, shards: int, row: str = "row", *, seed: int = 42, epoch: int = 0) -> None:
    """Parquet in an epoch's order: shard k holds the k-th stretch of places, sorted. One shuffle, by shard."""
    placed = permuted(rows, n, row, seed=seed, epoch=epoch)
    per = max(1, -(-n // shards))
    dealt = placed.withColumn("_shard", F.floor(F.col("place") / F.lit(per)).cast("int"))
    dealt.repartitionByRange(shards, "_shard").sortWithinPartitions("place").drop("_shard").write.mode("overwrite").parquet(path)
