"""Nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected on a few directions drawn from a normal distribution: the squared
projected distance over the squared distance then follows a chi-square law. Vectors are
dealt into blocks of bounded size by their number, each with a kd-tree over its projections.
A query takes a block's projected neighbours in order of projected distance and verifies
their distance on the original vectors, until the chi-square test holds: were there
a vector nearer than the k-th found so far, its projected distance would by now have been
seen with probability `confidence`. Blocks' best are merged to the overall k nearest.

Work goes by a grid of vector blocks and query blocks: every task holds one block of either
kind, whatever the number of vectors and queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite and not null."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def chi_square_cdf(x: float, m: int) -> float:
    """P(chi-square of m degrees of freedom <= x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = m / 2, x / 2
    if z > 700:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi_square_point(p: float, m: int) -> float:
    """The x at which chi_square_cdf is p."""
    low, high = 0.0, 10.0 * m + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


def directions(dim: int, m: int, seed: int = 13) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


class KdTree:
    """A kd-tree over points; leaves hold at most `leaf` points, contiguous in `order`."""

    def __init__(self, points: np.ndarray, leaf: int = 64):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple[np.ndarray, np.ndarray, int, int, int, int]] = []  # box low, box high, start, end, left, right
        self._build(0, len(points), leaf)

    def _build(self, start: int, end: int, leaf: int) -> int:
        own = self.order[start:end]
        low, high = self.points[own].min(0), self.points[own].max(0)
        at = len(self.nodes)
        self.nodes.append((low, high, start, end, -1, -1))
        if end - start > leaf:
            axis = int((high - low).argmax())
            half = (end - start) // 2
            self.order[start:end] = own[np.argpartition(self.points[own, axis], half)]
            left = self._build(start, start + half, leaf)
            right = self._build(start + half, end, leaf)
            self.nodes[at] = (low, high, start, end, left, right)
        return at

    def leaves(self, q: np.ndarray):
        """(squared distance to the box, points) of leaves, nearest box first."""
        heap = [(0.0, 0)]
        while heap:
            d, at = heapq.heappop(heap)
            _, _, start, end, left, right = self.nodes[at]
            if left < 0:
                yield d, self.order[start:end]
                continue
            for child in (left, right):
                low, high = self.nodes[child][:2]
                gap = np.maximum(0, np.maximum(low - q, q - high))
                heapq.heappush(heap, (float(gap @ gap), child))


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, *, k: int, m: int, confidence: float) -> list[tuple[int, int, float]]:
    """(query id, vector id, distance) of each query's k nearest found in the block.

    Leaves come in order of their boxes' projected distance, and all points of a leaf are
    verified together; the test is made before each leaf, against the nearest projected
    distance that an unseen point can have.
    """
    proj = directions(vectors.shape[1], m)
    tree = KdTree(vectors @ proj)
    point = chi_square_point(confidence, m)
    out = []
    for q, qid, p in zip(queries, query_ids.tolist(), queries @ proj):
        best_d, best_i = np.zeros(0), np.zeros(0, dtype=np.int64)
        kth = math.inf
        for gap, members in tree.leaves(p):
            if gap > point * kth * kth:
                break
            members = members[ids[members] != qid]
            diff = vectors[members] - q
            d = np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1])  # summed in order, so the same on every machine
            near = d <= kth
            best_d, best_i = np.concatenate([best_d, d[near]]), np.concatenate([best_i, ids[members[near]]])
            if len(best_d) > k:
                top = np.lexsort((best_i, best_d))[:k]
                best_d, best_i = best_d[top], best_i[top]
            if len(best_d) == k:
                kth = float(best_d.max())
        out += [(qid, int(i), float(d)) for i, d in zip(best_i, best_d)]
    return out


def _searcher(k: int, m: int, confidence: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, float]] = []
        for size in sorted(set(queries["dim"]) & set(vectors["dim"])):
            v, q = vectors[vectors["dim"] == size], queries[queries["dim"] == size]
            stack = lambda s: np.array(s.tolist(), dtype=np.float64)
            rows += search_block(stack(q["vector"]), q["vec_id"].to_numpy(), stack(v["vector"]), v["vec_id"].to_numpy(), k=k, m=m, confidence=confidence)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 10, m: int = 10, confidence: float = 0.9, block: int = 16_384, query_block: int = 32_768) -> DataFrame:
    """The k nearest found of each query row among all other rows: query_id, rank, vec_id, score.

    vectors(vec_id, embedding). Rows whose vec_id or vector is null, zero, or holds a null or
    non-finite component take no part. Vectors of another length than the query's are no candidates.
    Rows of the query's own id are not its neighbours; ids are expected to be
    unique, and a repeated one counts as often as it stands. Equal distances go to the smaller id.
    Fewer candidates than k give them all; an empty table gives an empty one.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.size("embedding").alias("dim"), is_query.alias("is_query"))
    n = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("q")).first()
    blocks, query_blocks = max(1, -(-n.n // block)), max(1, -(-n.q // query_block))
    deal = lambda salt, count: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.select("vec_id", "vector", "dim", deal("v", blocks).alias("vb")).withColumn("qb", every(query_blocks))
    right = rows.filter("is_query").select(*[F.col(x).alias(x) for x in ("vec_id", "vector", "dim")], deal("q", query_blocks).alias("qb")).withColumn("vb", every(blocks))
    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(_searcher(k, m, confidence), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def ann_query(vectors: DataFrame) -> DataFrame:
    """The contract's search, by `nearest`, whose edge cases hold: queries are the rows whose vec_id is divisible by 100."""
    return nearest(vectors, F.pmod("vec_id", F.lit(100)) == 0)
