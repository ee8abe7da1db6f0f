"""Near-duplicate embeddings by a robust-pruned flat graph over overlapping cluster shards.

Equal vectors form a class of one representative. Centroids are fitted on a bounded, thinned
sample; every class goes to the shards of its nearest centroids, `overlap` of them. Each shard
builds a flat graph: a node's pool is its nearest members and some random ones, and robust
pruning drops a neighbour when a kept one is much nearer to it than the node is. A node's adjacency lists of
all its shards are united. Each member then searches its shard: greedily from the shard's
medoid and from its own node, and on over everything within range, until no node in range
is unexpanded. Every link is verified by the cosine in double precision.

No table of pairs is made: a shard returns one link to the root of its local component for each member. What is linked
directly stands in one component, so links are counted there, exactly and from both ends alike, by products of blocks of a component's members.
Shards beyond `block` members are dealt into blocks that build graphs of their own, and every
block of queries searches every block of the shard.

A bounded sample of classes, dealt evenly over levels of links found, is audited against brute force:
each class counts by its share of links found, weighted by what it stands for, and each level of true links
must reach the recall by itself, so that a large group says nothing about small ones. If a level's recall is
too low, it all runs again with more overlap and longer lists; if the last attempt's still is, every
pair of blocks is compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann import usable
from .common import cut, ship_package
from .components import components

THRESHOLD = 0.95


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def stack(s: pd.Series) -> np.ndarray:
    return np.array(s.tolist(), dtype=np.float64)


def thin(x: np.ndarray, cosine: float = 0.9) -> np.ndarray:
    """Of unit vectors, those not near an earlier one: a large group of copies weighs as one."""
    keep = np.ones(len(x), dtype=bool)
    for i in range(0, len(x), 512):
        part = x[i : i + 512]
        before = x[:i][keep[:i]]
        if len(before):
            keep[i : i + 512] &= (part @ before.T).max(1) < cosine
        own = np.tril(part @ part.T, -1) >= cosine
        keep[i : i + 512] &= ~own.any(1)
    return x[keep]


def centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means of a thinned sample."""
    x = thin(unit(sample))
    r = np.random.default_rng(seed)
    c = x[r.permutation(len(x))[: max(1, min(count, len(x)))]]
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def build(x: np.ndarray, *, near: int, spread: int, degree: int, alpha: float = 1.2, extra: int = 12, least_in: int = 6, seed: int = 5) -> np.ndarray:
    """Adjacency (n x degree + extra, -1 for none) of unit vectors by robust pruning of pools.

    A pool is the `near` nearest members and `spread` random ones; pruning takes the nearest
    left, and drops those p for which alpha times the distance to the one taken is at most
    the distance from p to the node.
    """
    n = len(x)
    out = np.full((n, degree + extra), -1, dtype=np.int32)
    if n == 1:
        return out
    close = np.zeros((n, min(near, n - 1)), dtype=np.int32)
    r = np.random.default_rng(seed)
    near = min(near, n - 1)
    for i in range(0, n, 512):
        rows = np.arange(i, min(i + 512, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -2
        pool = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        close[rows] = np.take_along_axis(pool, np.argsort(-np.take_along_axis(sims, pool, 1), axis=1, kind="stable"), 1)
        pool = np.concatenate([pool, r.integers(0, n, size=(len(rows), spread))], 1)
        got = np.take_along_axis(sims, pool, 1)
        order = np.argsort(-got, axis=1, kind="stable")
        pool, got = np.take_along_axis(pool, order, 1), np.take_along_axis(got, order, 1)
        # distances of unit vectors, squared: 2 - 2 cos
        to_node = 2 - 2 * got
        alive = got > -1.5
        v = x[pool]
        for k in range(degree):
            first = alive.argmax(1)
            some = alive[np.arange(len(rows)), first]
            out[rows[some], k] = pool[some, first[some]]
            between = 2 - 2 * np.einsum("nd,npd->np", v[np.arange(len(rows)), first], v)
            alive &= alpha * alpha * between > to_node
            alive[np.arange(len(rows)), first] = False
            if not alive.any():
                break
    # reverse edges for nodes that few others point to, from those of their nearest that have the fewest such edges
    entering = np.bincount(out[out >= 0], minlength=n)
    given = np.zeros(n, dtype=np.int32)
    for i in np.flatnonzero(entering < least_in).tolist():
        sources = close[i][np.argsort(given[close[i]], kind="stable")][: least_in - entering[i]]
        for j in sources.tolist():
            if given[j] < extra:
                out[j, degree + given[j]] = i
                given[j] += 1
    return out


def search(queries: np.ndarray, own: np.ndarray, x: np.ndarray, adjacency: np.ndarray, medoid: int, *, beam: int = 16, steps: int = 48, threshold: float = THRESHOLD) -> np.ndarray:
    """hits (queries x nodes): nodes found within range. own: the query's node, or -1."""
    nq, n = len(queries), len(x)
    hits, seen = np.zeros((nq, n), dtype=bool), np.zeros((nq, n), dtype=bool)
    every = np.arange(nq)

    def look(q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        s = np.concatenate([np.einsum("ij,ij->i", queries[q[i : i + 65536]], x[nodes[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0)])
        seen[q, nodes] = True
        hits[q[s >= threshold], nodes[s >= threshold]] = True
        return s

    ids = np.full((nq, beam), -1, dtype=np.int64)
    sims = np.full((nq, beam), -3.0)
    done = np.ones((nq, beam), dtype=bool)
    ids[:, 0], sims[:, 0], done[:, 0] = medoid, look(every, np.full(nq, medoid)), False
    other = np.flatnonzero((own >= 0) & (own != medoid))
    if beam > 1 and len(other):
        ids[other, 1], sims[other, 1], done[other, 1] = own[other], look(other, own[other]), False
    for _ in range(steps):
        open_sims = np.where(done, -4.0, sims)
        best = open_sims.argmax(1)
        active = np.flatnonzero(open_sims[every, best] > -3.5)
        if not len(active):
            break
        done[active, best[active]] = True
        nodes = adjacency[ids[active, best[active]]]
        q = np.repeat(active, nodes.shape[1])
        flat = nodes.ravel()
        fresh = flat >= 0
        fresh[fresh] &= ~seen[q[fresh], flat[fresh]]
        got = np.full(len(flat), -3.0)
        got[fresh] = look(q[fresh], flat[fresh])
        all_ids = np.concatenate([ids[active], np.where(fresh, flat, -1).reshape(nodes.shape)], 1)
        all_sims = np.concatenate([sims[active], got.reshape(nodes.shape)], 1)
        all_done = np.concatenate([done[active], ~fresh.reshape(nodes.shape)], 1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[active], sims[active], done[active] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
    expanded = np.zeros((nq, n), dtype=bool)
    while True:
        q, nodes = np.nonzero(hits & ~expanded)
        if not len(q):
            return hits
        expanded[q, nodes] = True
        for i in range(0, len(q), 16384):
            nb = adjacency[nodes[i : i + 16384]]
            qq, nb = np.repeat(q[i : i + 16384], nb.shape[1]), nb.ravel()
            ok = nb >= 0
            key = np.unique(qq[ok] * np.int64(n) + nb[ok])
            qq, nb = key // n, key % n
            new = ~seen[qq, nb]
            look(qq[new], nb[new])


def _assigner(c: np.ndarray, overlap: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                sims = unit(stack(pdf["vector"])) @ c.T
                yield pdf.assign(shards=list(np.argsort(-sims, axis=1, kind="stable")[:, :overlap].astype(np.int32)))

    return run


def _builder(near: int, spread: int, degree: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        a = build(unit(stack(pdf["vector"])), near=near, spread=spread, degree=degree)
        return pd.DataFrame({"id": ids, "near": [ids[row[row >= 0]] for row in a]})

    return run


def _roots(left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id of each node's component, given links as pairs of positions."""
    root = ids.copy()
    while True:
        least = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(least, left, low)
        np.minimum.at(least, right, low)
        if (least == root).all():
            return root
        root = least


def _united(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Roots after more links between positions: components that a link joins get the lesser root."""
    a, b = root[left], root[right]
    apart = a != b
    if not apart.any():
        return root
    labels, at = np.unique(np.concatenate([a[apart], b[apart]]), return_inverse=True)
    least = _roots(at[: len(at) // 2], at[len(at) // 2 :], labels)
    place = np.minimum(np.searchsorted(labels, root), len(labels) - 1)
    return np.where(labels[place] == root, least[place], root)


def _rooted(qids: np.ndarray, ids: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """(id, root) of those that links, given as pairs of positions in qids and ids, join to a lesser id; a few links at a time."""
    every, at = np.unique(np.concatenate([qids, ids]), return_inverse=True)
    root = every
    for q, node in found:
        root = _united(root, at[q], at[len(qids) + node])
    return pd.DataFrame({"id": every, "root": root})[root != every]


_NONE = {"id": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)}


def _searcher() -> Callable:
    def run(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(queries):
            return pd.DataFrame(_NONE)
        graph, queries = graph.sort_values("id").reset_index(drop=True), queries.sort_values("id").reset_index(drop=True)
        ids, x = graph["id"].to_numpy(), unit(stack(graph["vector"]))
        degree = max(1, int(graph["near"].map(len).max()))
        adjacency = np.full((len(ids), degree), -1, dtype=np.int64)
        for i, row in enumerate(graph["near"]):
            row = np.asarray(row, dtype=np.int64)
            at = np.minimum(np.searchsorted(ids, row), len(ids) - 1)
            at = at[ids[at] == row]  # neighbours that are members here
            adjacency[i, : len(at)] = at
        mean = x.mean(0)
        medoid = int((x @ mean).argmax())
        qids, qx = queries["id"].to_numpy(), unit(stack(queries["vector"]))
        at = np.minimum(np.searchsorted(ids, qids), len(ids) - 1)
        own = np.where(ids[at] == qids, at, -1)

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i in range(0, len(qids), 512):
                q, node = np.nonzero(search(qx[i : i + 512], own[i : i + 512], x, adjacency, medoid))
                yield q + i, node

        return _rooted(qids, ids, found())

    return run


def _counter() -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of a cell: of its block's members among themselves, or of one block's with the other's."""
        across = pdf["i"].iloc[0] != pdf["j"].iloc[0]
        own = pdf[pdf["half"] == pdf["i"]] if across else pdf
        other = pdf[pdf["half"] == pdf["j"]] if across else pdf
        ids, x, copies, comp = (own["id"].to_numpy(), unit(stack(own["vector"])), own["copies"].to_numpy(), own["component"].to_numpy()) if len(own) else (np.zeros(0, np.int64),) * 4
        if not len(own) or not len(other):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        y, more, comp_y = unit(stack(other["vector"])), other["copies"].to_numpy(), other["component"].to_numpy()
        links, back = np.zeros(len(own), dtype=np.int64), np.zeros(len(other), dtype=np.int64)
        for k in range(0, len(own), 512):
            hit = (x[k : k + 512] @ y.T >= THRESHOLD) & (comp[k : k + 512, None] == comp_y[None, :])
            if not across:
                hit[np.arange(hit.shape[0]), np.arange(k, k + hit.shape[0])] = False
            links[k : k + 512] = hit @ more
            if across:
                back += copies[k : k + 512] @ hit
        out = pd.DataFrame({"id": ids, "links": links})
        return pd.concat([out, pd.DataFrame({"id": other["id"].to_numpy(), "links": back})]) if across else out

    return run


def _counted(classes: DataFrame, comps: DataFrame, block: int, small: int = 64) -> DataFrame:
    """(id, links): how many vectors of other classes each class of a component is linked with directly, exactly.

    Components of at most `small` classes share cells; a larger one is dealt into pairs of blocks."""
    rows = classes.join(comps, "id")
    sizes = comps.groupBy("component").agg(F.count("*").alias("n"))
    few = F.col("n") <= small
    spread = max(1, -(-comps.count() // block))
    rows = rows.join(sizes, "component").withColumn("few", few).withColumn("cell", F.when(few, F.pmod(F.xxhash64("component"), F.lit(spread))).otherwise(F.col("component")))
    blocks = F.when(few, 1).otherwise(F.ceil(F.col("n") / block)).cast("int")
    rows = rows.withColumn("half", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("i", F.least("half", "other")).withColumn("j", F.greatest("half", "other"))
    cells = rows.select("few", "cell", "i", "j", "half", "id", "component", "vector", "copies").groupBy("few", "cell", "i", "j")
    return cells.applyInPandas(_counter(), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _auditor(ids: np.ndarray, x: np.ndarray) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                hit = x @ unit(stack(pdf["vector"])).T >= THRESHOLD
                hit &= ids[:, None] != pdf["id"].to_numpy()[None, :]
                yield pd.DataFrame({"id": ids, "n": hit @ pdf["copies"].to_numpy()})

    return run


def _level(n: Column) -> Column:
    """0 for no links, then one level for each power of four."""
    return F.when(n > 0, 1 + F.floor(F.log(n.cast("double") + 0.5) / F.log(F.lit(4.0)))).otherwise(0).cast("int")


def _recall(classes: DataFrame, found: DataFrame, rows: int) -> float:
    """The least recall of any level of true links, by about `rows` classes dealt evenly over levels of links found."""
    levelled = classes.join(found, "id", "left").withColumn("links", F.coalesce("links", F.lit(0))).withColumn("level", _level(F.col("links")))
    sizes = {r["level"]: r["count"] for r in levelled.groupBy("level").count().collect()}  # at most 32 rows
    quota = max(1, rows // len(sizes))
    parts = [levelled.filter(F.col("level") == k).orderBy(F.xxhash64("id", F.lit(23)), "id").limit(quota).toPandas() for k in sorted(sizes)]
    weights = {k: sizes[k] / len(p) for k, p in zip(sorted(sizes), parts)}
    audited = pd.concat(parts).drop_duplicates("id")
    ids = audited["id"].to_numpy()
    exact = classes.mapInPandas(_auditor(ids, unit(stack(audited["vector"]))), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    true = exact.withColumn("true", _level(F.col("n"))).filter("n > 0").toPandas().merge(audited, on="id")
    if not len(true):
        return 1.0
    w = true["level"].map(weights).to_numpy(dtype=float)
    share = np.minimum(1.0, true["links"].to_numpy() / true["n"].to_numpy())
    levels = true["true"].to_numpy()
    return float(min((w * share)[levels == k].sum() / w[levels == k].sum() for k in np.unique(levels)))


def _comparer() -> Callable:
    def run(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(queries):
            return pd.DataFrame(_NONE)
        ids, x = graph["id"].to_numpy(), unit(stack(graph["vector"]))
        qids, qx = queries["id"].to_numpy(), unit(stack(queries["vector"]))

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i in range(0, len(qids), 512):
                q, node = np.nonzero(qx[i : i + 512] @ x.T >= THRESHOLD)
                yield q + i, node

        return _rooted(qids, ids, found())

    return run


def _compare(classes: DataFrame, n: int, block: int) -> DataFrame:
    """What _link gives, from every pair of blocks of classes compared exactly: work grows with the square of n."""
    blocks = -(-n // block)
    rows = classes.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("gb"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    graph = rows.withColumn("qb", other)
    queries = rows.withColumnRenamed("gb", "qb").withColumn("gb", other)
    return cut(graph.groupBy("gb", "qb").cogroup(queries.groupBy("gb", "qb")).applyInPandas(_comparer(), "id long, root long"))


def _link(classes: DataFrame, n: int, *, overlap: int, near: int, spread: int, degree: int, shard: int, block: int, sample_rows: int) -> DataFrame:
    """(id, root): links to local roots."""
    sample = classes.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(sample_rows).select("vector").toPandas()
    c = centroids(stack(sample["vector"]), min(2048, max(1, -(-n // shard))))
    overlap = min(overlap, len(c))
    placed = cut(classes.select("id", "vector").mapInPandas(_assigner(c, overlap), "id long, vector array<double>, shards array<int>"))
    members = placed.select("id", "vector", F.explode("shards").alias("shard"))
    sizes = members.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # at most 2048 rows
    members = members.join(F.broadcast(sizes), "shard").withColumn("gb", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    lists = members.groupBy("shard", "gb").applyInPandas(lambda pdf: _builder(near, spread, degree)(pdf), "id long, near array<long>")
    united = cut(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))  # at most overlap x degree each
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    graph = members.join(united, "id").withColumn("qb", blocks).select("shard", "gb", "qb", "id", "vector", "near")
    queries = members.withColumnRenamed("gb", "qb").withColumn("gb", blocks).select(*[F.col(x).alias(x) for x in ("shard", "gb", "qb", "id", "vector")])
    return cut(graph.groupBy("shard", "gb", "qb").cogroup(queries.groupBy("shard", "gb", "qb")).applyInPandas(_searcher(), "id long, root long"))


def near_vectors(vectors: DataFrame, *, overlap: int = 2, near: int = 32, spread: int = 16, degree: int = 24, shard: int = 1500, block: int = 4096, sample_rows: int = 8192, audit_rows: int = 200, least_recall: float = 0.98, attempts: int = 3, audits: list | None = None) -> DataFrame:
    """One row per row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept.

    audits, if given, gets the measured recall of each attempt.

    Vectors that are null, zero, or hold null or non-finite components link with nothing and
    are kept; so are those of a null vec_id, whose component is null. Vectors of different lengths
    never link. Equal vectors all link; repeated rows of one vec_id count as links of each
    other. An empty table gives an empty one. Other columns are not read.
    """
    ship_package(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    good = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    classes = cut(good.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).select("id", "vector", "copies"))
    # an id with several vectors stands for one class only in the tables below
    counts, tied = [], []
    for dim, n in sorted((r["dim"], r["count"]) for r in classes.groupBy(F.size("vector").alias("dim")).count().collect()):
        own = classes.filter(F.size("vector") == dim)
        for attempt in range(attempts + 1):
            exact = attempt == attempts
            found = _compare(own, n, block) if exact else _link(own, n, overlap=overlap + 2 * attempt, near=near << attempt, spread=spread, degree=degree << attempt, shard=shard, block=block, sample_rows=sample_rows)
            comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
            links = cut(_counted(own, comps, block))
            recall = 1.0 if exact else _recall(own, links, audit_rows)
            if audits is not None:
                audits.append({"dim": dim, "attempt": attempt, "exact": exact, "recall": recall})
            if recall >= least_recall:
                break
        counts.append(links)
        tied.append(comps)
    out = vectors.select("vec_id", "vector").join(classes.withColumnRenamed("vector", "class_vector"), F.col("vector") == F.col("class_vector"), "left") if counts else vectors.withColumn("id", F.lit(None).cast("long")).withColumn("copies", F.lit(1))
    if len(counts) > 1:
        # an id may stand for vectors of several lengths
        links = reduce(DataFrame.unionAll, counts).groupBy("id").agg(F.sum("links").alias("links"))
        comps = components(cut(reduce(DataFrame.unionAll, tied)).select(F.col("id").alias("a"), F.col("component").alias("b")))
    if counts:
        out = out.join(links, "id", "left").join(comps, "id", "left")
    else:
        out = out.withColumn("links", F.lit(0)).withColumn("component", F.lit(None).cast("long"))
    mine = F.col("vec_id").isNotNull()
    out = out.select(
        "vec_id",
        F.when(mine, F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(mine, F.coalesce("component", "id", "vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
