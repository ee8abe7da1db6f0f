"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are integers and stand in m parts of neighbouring components. Each part is a list of
its own: it knows local scores, the inner products of its components, and an overall score is their sum over
the parts. Vectors and queries are dealt into blocks; a node is one part of a block of vectors.

1. Each node gives every query its k best local scores. Of the vectors gathered so, overall scores
   are resolved; the k-th best is a bound t that the k-th best of all can't be below.
2. The cutoff t / m goes out with the queries. A vector of an overall score of t or more has a local score of
   t / m or more in some part, so what nodes collect at or above the cutoff holds all of them.
   What a vector's collected scores allow, the cutoff standing in for the others, rules out most.
3. The remaining ones' scores are resolved exactly, and the best k are taken.

Equal vectors form a class that is searched once, with its k + 1 smallest ids, and equal queries
are searched once: a group of copies costs what one vector costs. A node holds a block of vectors of one part,
and goes through queries and what it finds a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import cut, ship_package, trim

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Not null, all components finite and not null."""
    finite = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def scaled(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double; what is beyond a long is the nearest long."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly: as doubles or longs where they hold every sum, else as Python's integers."""
    high = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if high < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if high < 2**62:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of number lists as rows, shorter ones continued by zeros."""
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), dtype=np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy()
    return out


def _whole(scores: np.ndarray) -> np.ndarray:
    """Exact scores as longs; beyond them the nearest."""
    return np.clip(scores, LEAST, MOST).astype(np.int64)


@F.arrow_udf(LongType())
def _score(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for low in range(0, len(a), 4096):
        x, y = a.slice(low, 4096), b.slice(low, 4096)
        width = max([0, *x.value_lengths().to_pylist(), *y.value_lengths().to_pylist()])
        x, y = _matrix(x, width), _matrix(y, width)
        high = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(y.astype(np.float64)).max(initial=0)) * max(1, width)
        out.append(np.einsum("ij,ij->i", x, y) if high < 2**62 else _whole((x.astype(object) * y.astype(object)).sum(1)))
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))


def _cells(batches: Iterator[pa.RecordBatch], width: int, chunk: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, vector ids, vectors, query ids, queries, bounds) of each cell, queries a few at a time; rows come by cell, vectors first."""
    cell, ids, mats, done = None, [], [], None
    for batch in batches:
        at = np.stack([batch.column(c).to_numpy() for c in ("part", "vb", "qb", "kind")], 1)
        edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
        for low, high in zip(edges[:-1], edges[1:]):
            if low == high:
                continue
            now, kind = tuple(at[low, :3].tolist()), int(at[low, 3])
            if now != cell:
                cell, ids, mats, done = now, [], [], None
            rows = batch.slice(low, high - low)
            if not kind:
                ids.append(rows.column("id").to_numpy())
                mats.append(_matrix(rows.column("values"), width))
                continue
            if not ids:
                continue
            done = done or (np.concatenate(ids), np.concatenate(mats))
            for k in range(0, high - low, chunk):
                part = rows.slice(k, chunk)
                yield cell[0], *done, part.column("id").to_numpy(), _matrix(part.column("values"), width), part.column("bound").fill_null(LEAST).to_numpy()


def _pairs(q: np.ndarray, v: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(np.asarray(scores, dtype=np.float64))], ["q", "v", "local"])


def _gather(batches: Iterator[pa.RecordBatch], *, width: int, k: int, chunk: int = 128) -> Iterator[pa.RecordBatch]:
    """Each query's k best local scores of each node."""
    for _, ids, vectors, queries, own, _ in _cells(batches, width, chunk):
        local = products(own, vectors).astype(np.float64)
        top = np.argpartition(-local, k - 1, axis=1)[:, :k] if k < len(ids) else np.broadcast_to(np.arange(len(ids)), local.shape)
        yield _pairs(np.repeat(queries, top.shape[1]), ids[top].ravel(), np.take_along_axis(local, top, 1).ravel())
    trim()


def _collect(batches: Iterator[pa.RecordBatch], *, width: int, parts: int, chunk: int = 128) -> Iterator[pa.RecordBatch]:
    """All whose local score is at least the query's bound divided by the number of parts."""
    for _, ids, vectors, queries, own, bounds in _cells(batches, width, chunk):
        local = products(own, vectors)
        # a bound at the end of a long's range says nothing, as scores beyond are held to it
        cutoff = np.array([-(-int(b) // parts) if b > LEAST else -float("inf") for b in bounds], dtype=object)
        if local.dtype != object:
            cutoff = np.array([max(c, -(2.0**63)) if isinstance(c, float) else c for c in cutoff], dtype=np.float64 if local.dtype == np.float64 else object)
        i, j = np.nonzero((local >= cutoff[:, None]).astype(bool))
        yield _pairs(queries[i], ids[j], local[i, j])
    trim()


def _resolve(pairs: DataFrame, queries: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs(q, v) with their exact scores."""
    a, b = queries.select(F.col("id").alias("q"), F.col("vector").alias("a")), classes.select(F.col("id").alias("v"), F.col("vector").alias("b"))
    return pairs.join(a, "q").join(b, "v").select("q", "v", _score("a", "b").alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """Each query's k best rows. Spark limits a group before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def class_search(classes: DataFrame, queries: DataFrame, *, k: int, width: int, parts: int = 2, block: int = 16_384, query_block: int = 16_384) -> DataFrame:
    """The k best of classes(id, vector) for each of queries(id, vector), ids unique on either side: q, v, score, rank; ties to smaller ids.

    Vectors are arrays of longs of at most `width` components.
    """
    per = max(1, -(-width // parts))
    n, m = classes.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    deal = lambda salt, count: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")

    def nodes(rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", every(parts)).withColumn("values", F.slice("vector", F.col("part") * per + 1, F.lit(per))).drop("vector")

    vectors = nodes(classes.select("id", "vector", F.lit(None).cast("long").alias("bound"), deal("v", blocks).alias("vb"), F.lit(0).alias("kind"))).withColumn("qb", every(query_blocks))

    def grid(bounded: DataFrame) -> DataFrame:
        own = nodes(bounded.select("id", "vector", "bound", deal("q", query_blocks).alias("qb"), F.lit(1).alias("kind"))).withColumn("vb", every(blocks))
        return vectors.unionByName(own).repartition("part", "vb", "qb").sortWithinPartitions("part", "vb", "qb", "kind")

    kind = "q long, v long, local double"
    gathered = grid(queries.withColumn("bound", F.lit(None).cast("long"))).mapInArrow(partial(_gather, width=per, k=k), kind)
    resolved = cut(_best(_resolve(gathered.select("q", "v").distinct(), queries, classes), k))
    # fewer than k gathered: all are collected
    bounds = resolved.filter(F.col("rank") == k).select(F.col("q").alias("id"), F.col("score").alias("bound"))
    bounded = queries.join(bounds, "id", "left")
    collected = grid(bounded).mapInArrow(partial(_collect, width=per, parts=parts), kind)
    known = collected.groupBy("q", "v").agg(F.sum("local").alias("known"), F.sum(F.abs("local")).alias("size"), F.count("*").alias("seen"))
    known = known.join(bounds.withColumnRenamed("id", "q"), "q", "left")
    cutoff = F.ceil(F.col("bound") / F.lit(float(parts)))
    # doubles round; far less than the slack
    possible = F.col("known") + (F.lit(parts) - F.col("seen")) * cutoff + F.lit(1e-9) * (F.col("size") + F.abs("bound")) >= F.col("bound")
    remaining = cut(known.filter(F.col("bound").isNull() | possible).select("q", "v"))
    return _best(_resolve(remaining, queries, classes), k)


def top_products(vectors: DataFrame, is_query: Column, *, k: int = 10, scale: int = 1024, **sizes: int) -> DataFrame:
    """Each query row's k highest inner products of floor(scale * x) among all other rows: query_id, rank, vec_id, score.

    vectors(vec_id, embedding). Rows whose vec_id or vector is null, or whose vector holds a null or non-finite component, take no part.
    A vector of fewer components counts as continued by zeros, one of none scores 0. Components and scores beyond a long are held to
    the nearest one, and then tie. An id counts once: of several vectors the least one counts. Ties
    go to the smaller id. Fewer candidates than k give them all; an empty table gives an empty one. Other columns are not read.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("vector"), is_query.alias("asks"))
    if rows.groupBy("vec_id").count().filter("count > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    # copies of a vector are limited to k + 1 before they are shuffled
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    first = rows.select("vector", "vec_id").withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    classes = cut(first.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("id", F.get("ids", F.lit(0))))
    asked = cut(rows.filter("asks").select("vector", "vec_id").join(classes.select("vector", "id"), "vector").select("vec_id", F.col("id").alias("q")))
    queries = cut(classes.select("id", "vector").join(asked.select(F.col("q").alias("id")).distinct(), "id", "left_semi"))
    width = classes.agg(F.max(F.size("vector")).alias("n")).first().n or 1

    # k + 1 classes hold the k best rows beside the query's own: a class before another has a row before it
    found = class_search(classes, queries, k=k + 1, width=width, **sizes)
    rows = found.select("q", "v", "score").join(classes.select(F.col("id").alias("v"), "ids"), "v").select("q", "score", F.explode("ids").alias("v"))
    top = _best(rows, k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "v", "score"))).alias("top"))
    other = F.slice(F.filter("top", lambda t: t["v"] != F.col("vec_id")), 1, k)
    out = asked.join(top, "q").select(F.col("vec_id").alias("query_id"), F.posexplode(other).alias("at", "t"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("t.v").alias("vec_id"), F.col("t.score").alias("score"))


def topk_query(vectors: DataFrame) -> DataFrame:
    """The contract's search, by `top_products`, whose edge cases hold: queries are the rows whose vec_id is divisible by 100."""
    return top_products(vectors, F.pmod("vec_id", F.lit(100)) == 0)
