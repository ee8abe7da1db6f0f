"""Periodic runs of words, by a harmonic grid of longest-common-extension queries.

A run with period p and at least four periods of length covers three consecutive steps of the
grid 0, p, 2p, ... So for each p the places jp and (j+1)p are compared where the words
at jp, (j+1)p, (j+2)p and (j+3)p are equal: the longest common extension forward, by the suffix
array of the words, and backward, by that of the reversed words, give the whole stretch
that keeps period p. Grids of all periods have n log n places. Stretches found under several
periods keep the least, which is their smallest period.

An extension is the minimum of neighbouring suffixes' common prefixes between two ranks. The
suffix array comes by prefix doubling, and the common prefixes with it: two suffixes that part in the
step from k to 2k words share k and what the suffixes k further on share, a minimum over boundaries known before.
Minima come from a sparse table over blocks, so memory is linear, some 100 bytes a word of a text that has candidates.

A text is one row, so one task goes through it; Spark deals out the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, text_of, trim

LEAST_EXPONENT = 4
LEAST_LENGTH = 6
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


class RangeMinimum:
    """Minima of ranges of an array: a sparse table over blocks, and the ends of a range one place at a time."""

    def __init__(self, values: np.ndarray, block: int = 16):
        self.values, self.block = values, block
        whole = len(values) // block
        level = values[: whole * block].reshape(whole, block).min(1) if whole else np.zeros(0, values.dtype)
        self.table = [level]
        while len(self.table[-1]) > (half := 1 << (len(self.table) - 1)):
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """min(values[low:high]) of each pair; low < high."""
        b, v = self.block, self.values
        first, last = -(-low // b), high // b  # whole blocks between
        out = np.full(len(low), np.iinfo(v.dtype).max, dtype=v.dtype)
        left, right = np.minimum(first * b, high), np.maximum(last * b, low)
        for t in range(b):
            at = low + t
            ok = at < left
            if not ok.any():
                break
            out[ok] = np.minimum(out[ok], v[at[ok]])
        for t in range(1, b + 1):
            at = high - t
            ok = at >= right
            if not ok.any():
                break
            out[ok] = np.minimum(out[ok], v[at[ok]])
        some = np.flatnonzero(first < last)
        if len(some):
            a, n = first[some], (last - first)[some]
            k = np.frexp(n.astype(np.float64))[1] - 1  # the exponent of the largest power of two within n
            for level in np.unique(k):
                mine = k == level
                x, y, table = a[mine], n[mine], self.table[level]
                out[some[mine]] = np.minimum(out[some[mine]], np.minimum(table[x], table[x + y - (1 << level)]))
        return out


class Extensions:
    """Longest common prefixes of any two suffixes of a sequence of numbers 0 to m - 1, all of which stand in it."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        rank, shared, k = x.astype(np.int64), np.zeros(max(0, int(x.max()) if n else 0), dtype=np.int64), 1
        while n and len(shared) < n - 1:
            after = np.zeros(n, dtype=np.int64)
            after[: n - k] = rank[k:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.diff(key[order])) + 1  # where a group starts
            i, j = order[new - 1], order[new]
            grown = np.empty(len(new), dtype=np.int64)
            apart = rank[i] != rank[j]
            grown[apart] = shared[rank[i[apart]]]
            i, j = i[~apart] + k, j[~apart] + k
            more = np.zeros(len(i), dtype=np.int64)
            inside = (i < n) & (j < n)
            if inside.any():
                more[inside] = RangeMinimum(shared)(rank[i[inside]], rank[j[inside]])
            grown[~apart] = k + more
            starts = np.zeros(n, dtype=np.int64)
            starts[new] = 1
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(starts)
            shared, k = grown, 2 * k
        self.n, self.rank, self.minimum = n, rank, RangeMinimum(shared)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the suffixes from i and j agree; i and j differ and may be n."""
        out = np.zeros(len(i), dtype=np.int64)
        some = np.flatnonzero((i < self.n) & (j < self.n))
        if len(some):
            a, b = self.rank[i[some]], self.rank[j[some]]
            out[some] = self.minimum(np.minimum(a, b), np.maximum(a, b))
        return out


def _grid(x: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places jp, periods p) of grid steps whose words allow a run of four periods, a bounded number of steps at a time."""
    n = len(x)
    last = n // LEAST_EXPONENT
    low = 1
    while low <= last:
        # the steps of period p are at most n // p, those from low on at most n // low each
        high = min(last, low + max(1, most // (n // low)) - 1)
        p = np.arange(low, high + 1, dtype=np.int64)
        steps = (n - 1) // p - (LEAST_EXPONENT - 2)
        p = np.repeat(p, steps)
        j = np.arange(len(p), dtype=np.int64) - np.repeat(np.cumsum(steps) - steps, steps)
        at = j * p
        for t in range(LEAST_EXPONENT - 1):
            ok = x[at + t * p] == x[at + (t + 1) * p]
            at, p = at[ok], p[ok]
        if len(at):
            yield at, p
        low = high + 1


def runs_of(x: np.ndarray) -> np.ndarray:
    """Runs (start, length, period) of a sequence of numbers 0 to m - 1, all of which stand in it, by start, then period."""
    found, forward, backward, n = [], None, None, len(x)
    for at, p in _grid(x):
        if forward is None:
            forward, backward = Extensions(x), Extensions(x[::-1])
        start = at - backward(n - at, n - at - p)
        end = at + p + forward(at, at + p)
        ok = end - start >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * p)
        found.append(np.unique(np.stack([start[ok], end[ok], p[ok]], 1), axis=0))
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    rows = np.unique(np.concatenate(found), axis=0)  # by start, end, period
    least = np.ones(len(rows), dtype=bool)
    least[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[least]
    rows[:, 1] -= rows[:, 0]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def _numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int32, count=len(words))


def _batch(ids: list, runs: list[np.ndarray], texts: list[bytes]) -> pa.RecordBatch:
    rows = np.concatenate(runs) if runs else np.zeros((0, 3), dtype=np.int64)
    each = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], ["start", "length", "period"])
    ends = pa.array(np.cumsum([0, *[len(r) for r in runs]]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, each), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])


def _find(batches: Iterator[pa.RecordBatch], *, rewrite: Rewrite | None, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, runs, texts, held = [], [], [], 0
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.large_binary())):
            doc_id, words = doc_id.as_py(), text.as_py().split()  # of bytes, split() knows the six ASCII white spaces only
            if rewrite:
                words = rewrite(doc_id, words)
            own = runs_of(_numbers(words))
            if len(own):
                words = [w for w, k in zip(words, kept_words(len(words), own).tolist()) if k]
            ids.append(doc_id)
            runs.append(own)
            texts.append(b" ".join(words))
            held += len(texts[-1])
            if held >= most:
                yield _batch(ids, runs, texts)
                ids, runs, texts, held = [], [], [], 0
        yield _batch(ids, runs, texts)
        trim()


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """One row per row of docs: doc_id, runs, an array of (start, length, period) by start, then period, and the collapsed text.

    Words are separated by ASCII white space and numbered from 0. A run has at least four periods and six
    words. The collapsed text keeps each run's first period, its words joined by one space. rewrite may
    change the words of a document before. Null texts and texts without words have no runs and an empty
    collapsed text; rows may repeat, a doc_id may be null; an empty table gives an empty one. Only doc_id and text are read.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(partial(_find, rewrite=rewrite), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's repetition in every tenth document by the hash of its id; a null id leaves its text as it is."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def runs_query(docs: DataFrame) -> DataFrame:
    """The contract's digests of `periodic_runs`, whose edge cases hold: no run gives four nulls and the digest of the empty string.

    A null doc_id has no hash, so nothing is repeated in its text."""
    found = periodic_runs(docs, planted)
    # runs stand by start and period, so the first of equal exponents stays
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    kind = "struct<start:long,length:long,period:long>"
    best = F.aggregate("runs", F.lit(None).cast(kind), better)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    digest = lambda s: F.sha2(s.cast("binary"), 256)
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
