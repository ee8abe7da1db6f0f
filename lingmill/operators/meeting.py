"""Blocks of queries meet blocks of targets on a grid whose side is bounded, so that vectors are copied a bounded number of times.

Rows are dealt to groups in the order of their keys (a language, or a language and its cell), a key of many rows to several groups. Each
group of queries meets each group of targets in a task of its own: a vector is copied once for each group of the other side. The grid has about
TASKS tasks, whatever the number of vectors; only where a group would pass the block it has more.

Inside a task products are made in single precision, a few megabytes at a time. What reaches the k-th best within the error that single
precision can have is computed anew in double precision, so results are those of double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decimals of similarities, so that equal vectors tie however a product of blocks adds up.
DECIMALS = 12
#: Tasks of a grid, and the least rows that a group is made for.
TASKS, LEAST = 64, 1024
#: Numbers of a group's vectors and of a table of similarities, at most.
NUMBERS, HELD = 1 << 23, 1 << 23
FOUND = "src string, tgt string, i long, j long, sim double, wave int"


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    n = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(n == 0, 1, n)


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as rows, without Python objects."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(c), -1) for c in chunks if len(c)])


def best(q: np.ndarray, t: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of t, similarity) of the k most similar rows of t, the best first, ties to the smaller place. Rows are of length 1 or zero."""
    k, q32, t32 = min(k, len(t)), q.astype(np.float32), t.astype(np.float32).T
    error = 2.0**-23 * (q.shape[1] + 4) + 2 * 10.0**-DECIMALS
    at, of, sims = [], [], []
    step = max(1, HELD // len(t))
    for a in range(0, len(q), step):
        near = q32[a : a + step] @ t32
        floor = _floor(near, k) - 2 * error
        rows, cols = np.nonzero(near >= floor[:, None].astype(np.float32))
        many = np.bincount(rows, minlength=len(near)) > 64 + 8 * k  # copies, as a rule
        if many.any():
            some = ~many[rows]
            rows, cols = rows[some], cols[some]
            full = [_row(np.round(q[a + r] @ t.T, DECIMALS), place, k) for r in np.flatnonzero(many)]
            rows, cols = np.concatenate([rows, np.repeat(np.flatnonzero(many), k)]), np.concatenate([cols, *full])
        sim = np.round(np.einsum("ij,ij->i", q[a + rows], t[cols]), DECIMALS)
        order = np.lexsort((place[cols], -sim, rows))
        rows, cols, sim = rows[order], cols[order], sim[order]
        first = np.searchsorted(rows, rows)  # rows are in order
        kept = np.arange(len(rows)) - first < k
        at.append(a + rows[kept])
        of.append(cols[kept])
        sims.append(sim[kept])
    return np.concatenate(at), np.concatenate(of), np.concatenate(sims)


def _floor(near: np.ndarray, k: int, width: int = 64) -> np.ndarray:
    """At most the k-th largest of each row: the k-th largest of the maxima of stretches."""
    n = near.shape[1]
    if k == 1:
        return near.max(1)
    if n < 2 * k * width:
        return np.partition(near, n - k, axis=1)[:, n - k]
    whole = n // width * width
    peaks = near[:, :whole].reshape(len(near), -1, width).max(2)
    return np.partition(peaks, peaks.shape[1] - k, axis=1)[:, peaks.shape[1] - k]


def _row(sims: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The k largest of one row, of equal ones those of the smaller places."""
    kth = np.partition(sims, len(sims) - k)[len(sims) - k]
    over, ties = np.flatnonzero(sims > kth), np.flatnonzero(sims == kth)
    left = k - len(over)
    if left < len(ties):
        ties = ties[np.argpartition(place[ties], left - 1)[:left]]
    return np.concatenate([over, ties])


def stretches(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Where stretches of equal keys begin and end, in sorted arrays."""
    n = len(keys[0])
    changed = np.zeros(max(0, n - 1), dtype=bool)
    for key in keys:
        changed |= key[1:] != key[:-1]
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), n]
    return list(zip(cuts[:-1], cuts[1:])) if n else []


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lang, cell, pos and unit vectors, in that order."""
    lang = table["lang"].to_numpy(zero_copy_only=False).astype(object)
    cell, pos = table["cell"].to_numpy(), table["pos"].to_numpy()
    names, code = np.unique(lang.astype(str), return_inverse=True)
    order = np.lexsort((pos, cell, code))
    return names[code[order]], cell[order], pos[order], unit(vectors(table["emb"])[order])


def meet(k: int, pairs: frozenset[tuple[str, str]], plan: Callable | None = None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best targets of this group for each query of the other, by pair of languages. plan(src, query cells, tgt, target cells, k, search) goes
    through two languages' cells instead and gives the same rows; without one, each query meets all."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        if left.num_rows and right.num_rows:
            (ql, qc, qp, q), (tl, tc, tp, t) = _side(left), _side(right)
            for a, b in stretches(ql):
                for c, d in stretches(tl):
                    if (str(ql[a]), str(tl[c])) not in pairs:
                        continue
                    if plan is None:
                        found = [(*best(q[a:b], t[c:d], tp[c:d], k), None)]
                    else:
                        found = plan(str(ql[a]), qc[a:b], q[a:b], str(tl[c]), tc[c:d], t[c:d], tp[c:d], k)
                    for i, j, sim, wave in found:
                        i, j, sim = (i, j, pa.nulls(len(i), pa.float64())) if wave is not None else (qp[a:b][i], tp[c:d][j], pa.array(sim))
                        names = [pa.repeat(pa.scalar(str(x)), len(i)) for x in (ql[a], tl[c])]
                        waves = pa.nulls(len(i), pa.int32()) if wave is None else pa.array(wave, pa.int32())
                        made.append(pa.table([*names, pa.array(i, pa.int64()), pa.array(j, pa.int64()), sim, waves], names=["src", "tgt", "i", "j", "sim", "wave"]))
        if not made:
            return pa.schema([("src", pa.string()), ("tgt", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("sim", pa.float64()), ("wave", pa.int32())]).empty_table()
        return pa.concat_tables(made)

    return run


def dealt(rows: DataFrame, counts: DataFrame, keys: Sequence[str], total: int, groups: int, name: str) -> DataFrame:
    """Adds the group of each row: in the order of keys, each of about total / groups rows. counts(*keys, n) has a row a key."""
    start = F.sum("n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("_start", F.coalesce(start, F.lit(0)))
    # a uniform number from the hash spreads a key's rows evenly
    u = F.pmod(F.xxhash64("pos"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    at = F.floor((F.col("_start") + u * F.col("n")) * groups / F.lit(float(total)))
    return rows.join(F.broadcast(starts), list(keys)).withColumn(name, F.least(F.lit(groups - 1), at).cast("int")).drop("_start", "n")


def sides(queries: int, targets: int, block: int) -> tuple[int, int]:
    """Groups of queries and of targets: about TASKS pairs with the fewest copies, none of more than block rows."""
    most_q, most_t = max(1, math.ceil(queries / LEAST)), max(1, math.ceil(targets / LEAST))
    q = min(most_q, max(1, round(math.sqrt(TASKS * queries / max(1, targets)))))
    t = min(most_t, max(1, round(TASKS / q)))
    return max(q, math.ceil(queries / block)), max(t, math.ceil(targets / block))


def grid(queries: DataFrame, targets: DataFrame, pair: Column, k: int, *, keys: Sequence[str] = ("lang",), block: int | None = None, plan: Callable | None = None) -> DataFrame:
    """What the tasks of the grid find (src, tgt, i, j, sim, wave), of (lang, pos, emb) and, if keys name it, cell on either side.

    Sizes by key, dimensions and pairs of languages come to the driver or are broadcast; vectors don't.
    """
    count = lambda df: df.groupBy(*keys).agg(F.count("*").alias("n"))
    q_counts, t_counts = count(queries), count(targets)
    n_q, n_t = (c.agg(F.sum("n").alias("n")).first().n or 0 for c in (q_counts, t_counts))
    langs = q_counts.select(F.col("lang").alias("src")).distinct().join(t_counts.select(F.col("lang").alias("tgt")).distinct(), pair)
    pairs = frozenset((r.src, r.tgt) for r in langs.collect())
    if not n_q or not n_t or not pairs:
        return queries.sparkSession.createDataFrame([], FOUND)
    dim = targets.select(F.size("emb").alias("n")).first().n
    g_q, g_t = sides(n_q, n_t, min(block or NUMBERS, max(1, NUMBERS // max(1, dim))))
    cell = (lambda df: df) if "cell" in keys else (lambda df: df.withColumn("cell", F.lit(0).cast("long")))
    cols = [F.col(c).alias(c) for c in ("qg", "tg", "lang", "cell", "emb")] + [F.col("pos").cast("long").alias("pos")]  # both sides may come of the same rows
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = cell(dealt(queries, q_counts, keys, n_q, g_q, "qg")).withColumn("tg", every(g_t)).select(*cols)
    right = cell(dealt(targets, t_counts, keys, n_t, g_t, "tg")).withColumn("qg", every(g_q)).select(*cols)
    by = ["qg", "tg"]
    # more partitions than pairs of groups, so that few of them share one
    left, right = (df.repartition(2 * g_q * g_t, *by) for df in (left, right))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet(k, pairs, plan), FOUND)
