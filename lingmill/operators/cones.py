"""Nearest neighbours by an inverted file with cone bounds: exact, and without the block pairs that cannot matter.

Each language's vectors are dealt to cells, each around a direction found on a sample. A cell is a cone: its direction and the widest
angle of a member to it. No member of one cone is more similar to a member of another than the cosine of the angle between the
two directions less both widths. Cells are dealt in their order to the groups of a grid (see meeting.py), so vectors are copied once for each group of the other
side and not for each visit. In a task a cell of queries visits in two waves: first the nearest cells there, as many as
hold k vectors, then those whose bound still reaches the k-th similarity of one of its queries. Cells of queries that most others are open
to are searched together.

A cell of a third of all vectors lies in several groups; the number of cells,
and so what is broadcast, is bounded by `cells` for all languages together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship_package
from .meeting import best, grid, stretches, unit, vectors

#: What rounding may take from a bound.
SLACK = 1e-9
#: Rows whose similarities to all directions are held at once.
ROWS = 1024


def rounding(dim: int) -> float:
    """What rounding may add to or take from a cosine of unit vectors; near 1 that is an angle of some 1e-7, far beyond SLACK."""
    return (dim + 4) * 2.0**-52


def nearest_direction(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's most similar direction and that similarity, a few rows at a time."""
    at, near = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    for a in range(0, len(x), ROWS):
        sims = x[a : a + ROWS] @ own.T
        at[a : a + ROWS], near[a : a + ROWS] = sims.argmax(1), sims.max(1)
    return at, near


def directions(x: np.ndarray, count: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """count directions among unit rows, by spherical k-means."""
    own = x[np.random.default_rng(seed).permutation(len(x))[:count]]
    for _ in range(rounds):
        near = nearest_direction(x, own)[0]
        sums = np.zeros_like(own)
        np.add.at(sums, near, x)
        moved = unit(sums)
        own = np.where((moved != 0).any(1, keepdims=True), moved, own)
    return own


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    x = unit(np.array(pdf["emb"].tolist(), dtype=np.float64))
    own = directions(x, int(pdf["cells"].iloc[0]))
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "cell": np.arange(len(own)), "centre": list(own)})


def _assign(batches: Iterator[pa.RecordBatch], centres) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        if not langs:
            continue
        x = unit(vectors(batch.column("emb")))
        cell, near = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        by: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            by.setdefault(lang, []).append(i)
        for lang, at in by.items():
            cell[at], near[at] = nearest_direction(x[at], centres.value[lang])
        near[~(x != 0).any(1)] = -1  # a zero vector is at no angle; the widest cone holds it
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near)], [*batch.schema.names, "cell", "near"])


@dataclass(frozen=True)
class ConeIndex:
    """rows(lang, pos, emb, cell, block) and cones(lang, cell, centre, width, n), width being the widest angle of a member."""

    rows: DataFrame
    cones: DataFrame

    @classmethod
    def of(cls, emb: DataFrame, *, block: int = 4096, cells: int = 16_384, sample: int = 16) -> ConeIndex:
        """Of emb(lang, pos, emb): vectors of one length, without nulls. A language has a cell for each `block` of its vectors, as far as
        all have at most `cells`; directions come from about `sample` vectors a cell, chosen by a hash of their place."""
        spark = emb.sparkSession
        ship_package(spark)
        emb = emb.select("lang", "pos", F.col("emb").cast("array<double>").alias("emb"))
        counts = emb.groupBy("lang").agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n").alias("n")).first().n or 0
        share = cells / max(1, total)
        counts = counts.withColumn("cells", F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / block), F.floor(F.col("n") * share))).cast("int"))
        # a uniform number from the hash; languages of few vectors give all
        u = F.pmod(F.xxhash64("lang", "pos"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = emb.join(counts, "lang").filter(u < F.col("cells") * sample / F.col("n") + F.lit(1.0) / F.col("n"))
        fitted = drawn.groupBy("lang").applyInPandas(_fit, "lang string, cell long, centre array<double>").collect()
        by: dict[str, list] = {r.lang: [] for r in counts.select("lang").collect()}
        dim = len(fitted[0].centre) if fitted else 1
        for r in sorted(fitted, key=lambda r: (r.lang, r.cell)):
            by[r.lang].append(r.centre)
        # a language without a draw has one direction, whatever it is
        held = {k: np.array(v) if v else np.eye(1, dim) for k, v in by.items()}
        centres = spark.sparkContext.broadcast(held)
        rows = cut(emb.mapInArrow(partial(_assign, centres=centres), "lang string, pos long, emb array<double>, cell long, near double"))
        cones = rows.groupBy("lang", "cell").agg(F.count("*").alias("n"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("near") - rounding(dim)))).alias("width"))
        named = spark.createDataFrame([(k, i, row.tolist()) for k, v in held.items() for i, row in enumerate(v)], "lang string, cell long, centre array<double>")
        cones = cut(cones.join(named, ["lang", "cell"]))
        blocks = cones.select("lang", "cell", F.ceil(F.col("n") / block).alias("blocks"))
        rows = rows.join(blocks, ["lang", "cell"]).withColumn("block", F.pmod(F.xxhash64("pos"), F.col("blocks")).cast("int"))
        return cls(rows.select("lang", "pos", "emb", "cell", "block"), cones)


def _open(src, qc, q, tgt, tc, t, place, k, *, cones, visits):
    """For meeting.meet: two languages' cells in two waves. cones are either side's (lang, cell): (centre, width)."""
    qs, ts = stretches(qc), stretches(tc)
    (a, aw), (b, bw) = ((np.array([c[0] for c in side]), np.array([c[1] for c in side])) for side in ([cones.value[0][src, int(qc[x])] for x, _ in qs], [cones.value[1][tgt, int(tc[x])] for x, _ in ts]))
    cos = np.clip(a @ b.T, -1, 1)
    bound = np.cos(np.maximum(0, np.arccos(np.minimum(1, cos + rounding(a.shape[1]))) - aw[:, None] - bw[None, :])) + SLACK
    sizes, found, all_, went = np.array([y - x for x, y in ts]), [], [], []
    t_cells, q_cells = np.array([tc[x] for x, _ in ts]), np.array([qc[x] for x, _ in qs])
    rows = lambda some: np.concatenate([np.arange(*ts[c]) for c in np.flatnonzero(some)])
    for n, (x, y) in enumerate(qs):
        order = np.argsort(-cos[n], kind="stable")
        before = np.concatenate([[0], np.cumsum(sizes[order])[:-1]])
        first = np.zeros(len(ts), dtype=bool)
        first[order[before < k]] = True
        at = rows(first)
        i, j, sim = best(q[x:y], t[at], place[at], k)
        last = sim[k - 1 :: k] if len(at) >= k else np.full(1, -2.0)
        open_ = bound[n] >= last.min()
        if sizes[open_ | first].sum() > 0.8 * len(t):
            open_[:] = True
            all_.append(np.arange(x, y))
        else:
            if (open_ & ~first).any():
                at = rows(open_ | first)
                i, j, sim = best(q[x:y], t[at], place[at], k)
            found.append((x + i, at[j], sim, None))
        if visits:
            some = open_ | first
            went.append((np.full(some.sum(), q_cells[n]), t_cells[some], None, np.where(first[some], 0, 1)))
    if all_:
        at = np.concatenate(all_)
        i, j, sim = best(q[at], t, place, k)
        found.append((at[i], j, sim, None))
    return found + went


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("src", "tgt", "i").orderBy(F.desc("sim"), "j"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _meetings(queries: ConeIndex, targets: ConeIndex, pair: Column, k: int, *, visits: bool) -> DataFrame:
    spark = queries.rows.sparkSession
    # at most a row a cell, as what the index broadcasts
    sides = [queries.cones] if targets is queries else [queries.cones, targets.cones]
    q_cones, t_cones = ({(r.lang, r.cell): (np.array(r.centre), r.width) for r in c.collect()} for c in (sides[0], sides[-1]))
    held = spark.sparkContext.broadcast((q_cones, t_cones))
    own = lambda x: x.rows.select("lang", "pos", "emb", "cell")
    return grid(own(queries), own(targets), pair, k, keys=("lang", "cell"), plan=partial(_open, cones=held, visits=visits))


def cone_search(queries: ConeIndex, targets: ConeIndex, pair: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """The k most similar targets of each query (src, tgt, i, j, sim, rank; ties to the smaller position), and the
    cell pairs visited (src, tgt, qc, tc, wave), wave being the first in any task. pair is a condition over src and tgt. Similarities have 12 decimals.
    """
    met = cut(_meetings(queries, targets, pair, k, visits=True))
    went = met.filter("wave is not null").groupBy("src", "tgt", F.col("i").alias("qc"), F.col("j").alias("tc")).agg(F.min("wave").alias("wave"))
    return ranked(met.filter("wave is null").drop("wave"), k), went


def cone_nearest(queries: DataFrame, targets: DataFrame, pair: Column, k: int, **sizes: int) -> DataFrame:
    """The k most similar targets of each query: src, tgt, i, j, sim, rank, of (lang, pos, emb) on either side.

    An empty side gives an empty table. The same rows on either side are indexed once."""
    q = ConeIndex.of(queries, **sizes)
    t = q if targets is queries else ConeIndex.of(targets, **sizes)
    return ranked(_meetings(q, t, pair, k, visits=False).drop("wave"), k)
