"""Denoising noise on token sequences: permute, mask, insert, rotate.

Every random choice is a number drawn from the row's key, the step and a place, by whole-number arithmetic that SQL can state too. So
results don't depend on partitioning or on a task being run again, and all rows of an Arrow batch are treated at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


@dataclass(frozen=True)
class Noise:
    mask: float = 0.3
    random: float = 0.1
    insert: float = 0.0
    permute: float = 0.0
    rotate: float = 0.1
    span_rate: float | None = None  # of masked spans' Poisson lengths; None masks single tokens
    mask_id: int = 3
    stop_id: int = 4  # ends a sentence
    vocabulary: int = 32_000
    first_random: int = 10  # lower ids are never drawn

    def __post_init__(self):
        for name in ("mask", "random", "insert", "permute", "rotate"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        if self.span_rate is not None and self.span_rate <= 0:
            raise ValueError("span_rate must be positive")


TRAINING = Noise(mask=0.3, random=0.0, insert=0.1, permute=0.2, rotate=0.0)


P = (1 << 31) - 1
#: Of the draws: fixed multipliers, and a number for each kind of choice.
A, B, C, D, E, G = 1_103_515_245, 69_069, 362_437, 48_271, 1_013_904_223, 69_621
PERMUTE, MASK, RANDOM, MASK_TOKEN, INSERT, INSERT_TOKEN, ROTATE, SHIFT, SPAN, LENGTH = range(1, 11)


def draws(key: np.ndarray, kind: int, place: np.ndarray | int, seed: int = 0) -> np.ndarray:
    """Numbers from 0 to P - 1 for keys and places."""
    y = (key % P * A + (kind + 16 * seed) * B % P + place * C) % P
    y = (y * y % P * D + E) % P
    return (y * y % P * G + key % P) % P


def draw_sql(key: str, kind: int, place: str, seed: int = 0) -> str:
    """draws as SQL over BIGINTs."""
    first = f"({key} % {P} * {A} + {(kind + 16 * seed) * B % P} + {place} * {C}) % {P}"
    return f"list_transform(list_transform([{first}], lambda y : (y * y % {P} * {D} + {E}) % {P}), lambda y : (y * y % {P} * {G} + {key} % {P}) % {P})[1]"


class Rows:
    """Token sequences one after the other: values, the length and the key of each, and of each token its row and place."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray, keys: np.ndarray):
        self.values, self.lengths, self.keys = values, lengths, keys
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.starts = np.cumsum(lengths) - lengths
        self.place = np.arange(len(values)) - self.starts[self.row]

    @classmethod
    def of(cls, lists: list, keys: list) -> Rows:
        return cls(np.array([x for ids in lists for x in ids], dtype=np.int64), np.array([len(ids) for ids in lists], dtype=np.int64), np.array(keys, dtype=np.int64))

    def body(self) -> np.ndarray:
        """The tokens between the first and the last of rows of more than two."""
        return np.flatnonzero((self.place > 0) & (self.place < self.lengths[self.row] - 1))

    def sizes(self) -> np.ndarray:
        return np.maximum(0, self.lengths - 2)

    def by(self, *order: np.ndarray) -> Rows:
        """With tokens in another order within their rows."""
        return Rows(self.values[np.lexsort((*order[::-1], self.row))], self.lengths, self.keys)

    def lists(self) -> list[list[int]]:
        return [x.tolist() for x in np.split(self.values, np.cumsum(self.lengths)[:-1])] if len(self.lengths) else []


def _ranks(row: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Each item's rank from 0 within its row."""
    at = np.lexsort((*order[::-1], row))
    out = np.empty(len(row), dtype=np.int64)
    sorted_rows = row[at]
    out[at] = np.arange(len(row)) - np.searchsorted(sorted_rows, sorted_rows)
    return out


def _share(share: float, of: np.ndarray) -> np.ndarray:
    return np.ceil(share * of).astype(np.int64)


def permute(t: Rows, n: Noise, seed: int = 0) -> Rows:
    """Moves a share of the sentences of the body around; every token stays."""
    body = t.body()
    row, stop = t.row[body], (t.values[body] == n.stop_id).astype(np.int64)
    before = np.cumsum(stop) - stop
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=bool)
    part = before - np.maximum.accumulate(np.where(first, before, 0))
    new = first | np.concatenate([[False], part[1:] != part[:-1]]) if len(row) else first
    p_row, p = row[new], part[new]
    parts = np.bincount(p_row, minlength=len(t.lengths))
    count = np.where(parts > 1, _share(n.permute, parts), 0)
    drawn = draws(t.keys[p_row], PERMUTE, p, seed)
    chosen = np.flatnonzero(_ranks(p_row, drawn, p) < count[p_row])
    # the chosen in the order drawn stand where the chosen stand in their own order
    slot = p.copy()
    slot[chosen[np.lexsort((p[chosen], drawn[chosen], p_row[chosen]))]] = p[chosen]
    order = np.where(t.place == 0, -1, parts[t.row])
    order[body] = slot[np.cumsum(new) - 1]
    return t.by(order, t.place)


def _spans(t: Rows, n: Noise, seed: int) -> np.ndarray:
    """Which body tokens spans cover: rounds of one span a row, until each row has its share."""
    size, count = t.sizes(), _share(n.mask, t.sizes())
    covered, turn = np.zeros(len(t.values), dtype=bool), 0
    # lengths by the inverse of the Poisson distribution
    chance = [np.exp(-n.span_rate)]
    while sum(chance) < 1 - 1e-9 and len(chance) < 1000:
        chance.append(chance[-1] * n.span_rate / len(chance))
    upto = np.cumsum(chance)
    left = count.copy()
    while (active := np.flatnonzero(left > 0)).size:
        start = draws(t.keys[active], SPAN, turn, seed) % size[active]
        length = np.maximum(1, np.searchsorted(upto, draws(t.keys[active], LENGTH, turn, seed) / P))
        end = np.minimum(size[active], start + np.minimum(length, left[active]))
        runs = end - start
        at = np.repeat(t.starts[active] + 1 + start, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        left[active] -= np.bincount(np.repeat(np.arange(len(active)), runs), ~covered[at], minlength=len(active)).astype(np.int64)
        covered[at] = True
        turn += 1
    return covered


def mask(t: Rows, n: Noise, seed: int = 0) -> Rows:
    """Masks a share of the tokens between the first and the last; some get a random token instead."""
    body = t.body()
    row, place = t.row[body], t.place[body]
    if n.span_rate is None:
        at = body[_ranks(row, draws(t.keys[row], MASK, place, seed), place) < _share(n.mask, t.sizes())[row]]
    else:
        at = np.flatnonzero(_spans(t, n, seed))
    key, place = t.keys[t.row[at]], t.place[at]
    random = draws(key, RANDOM, place, seed) < n.random * P
    values = t.values.copy()
    values[at] = np.where(random, n.first_random + draws(key, MASK_TOKEN, place, seed) % (n.vocabulary - n.first_random), n.mask_id)
    return Rows(values, t.lengths, t.keys)


def insert(t: Rows, n: Noise, seed: int = 0) -> Rows:
    """Puts in new tokens between the first and the last, the first share of them random and the others masks."""
    count = np.where(t.lengths > 2, _share(n.insert, t.lengths), 0)
    randoms = _share(n.random, count)
    row = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    key = t.keys[row]
    at = 1 + draws(key, INSERT, number, seed) % np.maximum(1, t.lengths[row] - 1)
    rank = _ranks(row, at, number)
    new = np.where(rank < randoms[row], n.first_random + draws(key, INSERT_TOKEN, rank, seed) % (n.vocabulary - n.first_random), n.mask_id)
    # a new token stands before the token at its place
    order = np.lexsort((np.concatenate([rank, np.zeros(len(t.values), np.int64)]), np.concatenate([np.zeros(len(row), np.int8), np.ones(len(t.values), np.int8)]), np.concatenate([at, t.place]), np.concatenate([row, t.row])))
    return Rows(np.concatenate([new, t.values])[order], t.lengths + count, t.keys)


def rotate(t: Rows, n: Noise, seed: int = 0) -> Rows:
    """Turns the body of a share of the rows."""
    size = np.maximum(1, t.sizes())
    turned = draws(t.keys, ROTATE, 0, seed) < n.rotate * P
    shift = np.where(turned, draws(t.keys, SHIFT, 0, seed) % size, 0)
    order, body = t.place.copy(), t.body()
    order[body] = 1 + (t.place[body] - 1 - shift[t.row[body]]) % size[t.row[body]]
    return t.by(order)


def noised_rows(t: Rows, n: Noise, seed: int = 0) -> Rows:
    """permute, mask, insert, rotate, in that order; sequences of two tokens or fewer stay."""
    for step, share in ((permute, n.permute), (mask, n.mask), (insert, n.insert), (rotate, n.rotate)):
        if share > 0:
            t = step(t, n, seed)
    return t


def add_noise(ids: list[int], key: int, n: Noise, seed: int = 0) -> list[int]:
    """One sequence's noise."""
    return noised_rows(Rows.of([ids], [key]), n, seed).lists()[0]


def _slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` tokens, or a single row."""
    low, upto = 0, np.cumsum(lengths)
    while low < len(lengths):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + most, side="right")))
        yield low, high
        low = high


def noised(ids: Column, key: Column, n: Noise = TRAINING, seed: int = 0, most: int = 1 << 20) -> Column:
    """ids with noise by a whole-number key. Null ids stay null; a null key counts as 0."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(lists: pa.Array, keys: pa.Array) -> pa.Array:
        lengths, values, k = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy().astype(np.int64), keys.to_numpy()
        starts, parts = np.cumsum(lengths) - lengths, []
        for low, high in _slices(lengths, most):
            end = starts[high - 1] + lengths[high - 1]
            parts.append(noised_rows(Rows(values[starts[low] : end], lengths[low:high], k[low:high]), n, seed))
        made = np.concatenate([p.values for p in parts]) if parts else np.zeros(0)
        sizes = np.concatenate([p.lengths for p in parts]) if parts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(made.astype(np.int32)))

    empty = F.array().cast("array<int>")
    return F.when(ids.isNotNull(), run(F.coalesce(ids.cast("array<int>"), empty), F.coalesce(key.cast("long"), F.lit(0).cast("long"))))


def masked_by_rank(ids: Column, key: Column, share: float, mask_id: int) -> Column:
    """mask without Python: the positions whose hashes with the key are the smallest.

    The last hash to mask is found once for a row and handed to the inner function as its variable;
    a column named in there would be computed again for each token.
    """
    ranked = lambda i: F.struct(F.xxhash64(key, i).alias("h"), i.alias("i"))
    size = F.size(ids) - 2
    count = F.ceil(size * F.lit(float(share))).cast("int")
    hashed = F.array_sort(F.transform(F.sequence(F.lit(1), size), ranked))
    bound = F.struct(size.alias("size"), F.get(hashed, count - 1).alias("last"))
    masked = lambda b: F.transform(ids, lambda x, i: F.when((i >= 1) & (i <= b["size"]) & (ranked(i) <= b["last"]), F.lit(mask_id)).otherwise(x))
    return F.when(size < 1, ids).otherwise(F.transform(F.array(bound), masked)[0])
