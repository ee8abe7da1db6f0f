"""Near-duplicate documents by SetSketch registers.

One pass over the texts makes each document's set of distinct 5-word shingles, a digest of
it, and a SetSketch: register i holds the truncated logarithm, to a base near 1, of the
least of exponential variables that the shingles draw. Registers merge by maximum and are
locality sensitive: two sets agree in a register with a probability of at least their
similarity. Documents of equal sets form a class, and classes go on alone.

Bands of registers put classes into buckets. Rounds of pivots follow: each bucket whose
members stand in different components compares all of them with one member, the next in
an order by hash that all buckets share, and lets that one go. For each candidate pair the similarity is
estimated by the joint likelihood of the registers and the set sizes; pairs that the
estimate puts far below the threshold go, and the rest are confirmed on the full sets, each
document's best pair first. Links found so far give components; pairs whose ends already
share one need no check, as a link between them can change nothing. Rows of a round are at most
as many as there are members left.

Rounds end when no large bucket is open, or when what is open no longer shrinks. What is left then meets in blocks: small
buckets whole, each pair only in the first band it shares; large ones are first joined where they share members, so that
a pair meets once over all bands. Every pair of members of a bucket that still stand in
different components is compared there, so no bucket loses a link.

With r = 5 registers a band and 56 bands, a pair at 0.75 shares no bucket with a probability
under 3e-7. The estimate's standard error at 0.75 is 0.026; pairs are let go below 0.63.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from .common import cut, ship_package, text_of, trim
from .components import components, extended

ROWS, BANDS = 5, 56
REGISTERS = ROWS * BANDS
#: Base of the registers: 255 levels span set sizes of up to about 3e6.
BASE = 1.065
LEAST_ESTIMATE = 0.63
#: A bucket of so many members is compared in a task, whole.
SMALL = 64

_U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that stand one after the other in data; and where each text's words start."""
    data = _LOWER[data]
    n = len(data)
    word = ~_SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1]] = True
    starts = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | first[:n])) if n else np.zeros(0, dtype=np.int64)
    last = np.append(~word[1:] | first[1:n], True) if n else np.zeros(0, dtype=bool)
    ends = np.flatnonzero(word & last) + 1
    sums = np.zeros(n + 1, dtype=_U64)
    np.cumsum((data.astype(_U64) + _U64(1)) * _powers(_P, n), out=sums[1:])
    inverse = _powers(_P_INVERSE, n + 1)
    hashes = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U64) * _U64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    words, at = word_hashes(data, offsets)
    rolled = np.zeros(max(0, len(words) - width + 1), dtype=_U64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * _U64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
    rolled = _mix(rolled)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = np.array([int(w) * pow(0x165667B19E3779F9, k + 1, 1 << 64) & (1 << 64) - 1 for k, w in enumerate(words[a:b].tolist())], dtype=_U64)
            out.append(_mix(np.array([np.bitwise_xor.reduce(_mix(short)) + _U64(b - a)], dtype=_U64)))
        else:
            out.append(np.zeros(0, dtype=_U64))
    return out


def registers(sets: list[np.ndarray], count: int = REGISTERS, chunk: int = 1 << 16) -> np.ndarray:
    """SetSketch registers of non-empty sets, one row of bytes each."""
    r = np.random.default_rng(20240229)
    odd = r.integers(0, 1 << 32, size=(2, count), dtype=np.uint32) | np.uint32(1)
    shift = r.integers(0, 1 << 32, size=count, dtype=np.uint32)
    least = np.full((len(sets), count), 0xFFFFFFFF, dtype=np.uint32)
    lengths = np.array([len(s) for s in sets])
    ends = np.cumsum(lengths)
    items = (np.concatenate(sets) >> _U64(32)).astype(np.uint32) if sets else np.zeros(0, dtype=np.uint32)
    low = 0
    while low < len(items):
        high = min(len(items), low + chunk)
        a, b = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high - 1, side="right")
        cuts = np.concatenate([[0], ends[a:b] - low])
        x = items[low:high]
        v, t = np.empty_like(x), np.empty_like(x)
        for i in range(count):
            np.bitwise_xor(x, shift[i], out=v)
            np.multiply(v, odd[0, i], out=v)
            np.right_shift(v, 15, out=t)
            np.bitwise_xor(v, t, out=v)
            np.multiply(v, odd[1, i], out=v)
            least[a : b + 1, i] = np.minimum(least[a : b + 1, i], np.minimum.reduceat(v, cuts))
        low = high
    draw = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(draw) / np.log(BASE)) + 12, 0, 255).astype(np.uint8)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of pairs by the joint likelihood of their registers, given set sizes."""
    equal, more = (a == b).sum(1), (a > b).sum(1)
    less = a.shape[1] - equal - more
    u, v = na / (na + nb), nb / (na + nb)
    grid = np.linspace(0, 1, 201)[None, :]
    j = grid * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    return np.take_along_axis(j, (more[:, None] * log(up) + less[:, None] * log(down) + equal[:, None] * log(1 - up - down)).argmax(1)[:, None], 1)[:, 0]


def _texts(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, data, offsets) of runs of a column's texts, of about `most` bytes or a single text."""
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in _texts(batch.column("text")):
            sets = shingle_sets(data, offsets)
            some = [s for s in sets if len(s)]
            made = iter(registers(some))
            regs = [next(made).tobytes() if len(s) else None for s in sets]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "digest", "regs"])
        trim()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in _texts(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], pa.array([s.tobytes() for s in shingle_sets(data, offsets)], pa.binary())], ["id", "items"])
        trim()


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A column of binary values of one length, as rows of bytes, without Python objects."""
    column = column.cast(pa.large_binary())
    first = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[first : first + len(column) * width].reshape(-1, width)


@F.arrow_udf(DoubleType())
def _estimate(a: pa.Array, b: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
    trim()
    if not len(a):
        return pa.array([], pa.float64())
    x, y, n, m = _bytes(a, REGISTERS), _bytes(b, REGISTERS), na.to_numpy().astype(float), nb.to_numpy().astype(float)
    return pa.array(np.concatenate([estimate(x[i : i + 2048], y[i : i + 2048], n[i : i + 2048], m[i : i + 2048]) for i in range(0, len(x), 2048)]))


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sorted sets are at least 75 % similar, in whole numbers."""
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= 75 * (len(s) + len(t) - both)


@F.arrow_udf(BooleanType())
def _linked(a: pa.Array, b: pa.Array) -> pa.Array:
    trim()
    # one pair at a time: whole columns of sets would be copies of a batch
    return pa.array([linked(np.frombuffer(x.as_py(), dtype=_U64), np.frombuffer(y.as_py(), dtype=_U64)) for x, y in zip(a, b)], pa.bool_())


def _bands(classes: DataFrame) -> DataFrame:
    keys = [F.xxhash64(F.substring("regs", k * ROWS + 1, ROWS), F.lit(k)) for k in range(BANDS)]
    return classes.select("id", F.posexplode(F.array(*keys)).alias("band", "key"))


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose sizes allow a link and whose estimate doesn't rule it out, with the estimate."""
    side = lambda n: classes.select(F.col("id").alias(n), F.col("regs").alias(f"regs_{n}"), F.col("n_shingles").alias(f"n_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    return both.select("a", "b", _estimate("regs_a", "regs_b", "n_a", "n_b").alias("estimate")).filter(F.col("estimate") >= LEAST_ESTIMATE)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda n: sets.select(F.col("id").alias(n), F.col("items").alias(f"items_{n}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter(_linked("items_a", "items_b")).select("a", "b")


Group = dict[str, np.ndarray | list]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[Group]:
    """Columns of each run of equal keys, of batches that are sorted by them: numbers as arrays, binary values as lists."""
    held: dict[str, list] = {}

    def made() -> Group:
        return {c: np.concatenate(v) if isinstance(v[0], np.ndarray) else [x for part in v for x in part] for c, v in held.items()}

    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        by = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(n, dtype=bool)
        for v in by:
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for start, end in zip(cuts[:-1], cuts[1:]):
            now = [v[start] for v in by]
            if held and now != last:
                yield made()
                held = {}
            last = now
            for c in columns:
                part = batch.column(c).slice(start, end - start)
                held.setdefault(c, []).append(part.to_pylist() if pa.types.is_binary(part.type) else part.to_numpy())
    if held:
        yield made()


def _candidates(g: Group) -> Iterator[tuple[int, np.ndarray]]:
    """(row, later rows) of members that stand in different components and whose sizes and
    registers allow a link; in a bucket of a band, only pairs that share no earlier band.

    Registers are equal with a probability of at least the similarity, so a share of equal
    ones stands in for the estimate here: for sizes this near, one bounds the other."""
    comp, half, band = g["component"], g["half"], int(g["band"][0])
    if (comp == comp[0]).all():
        return
    regs = np.frombuffer(b"".join(g["regs"]), dtype=np.uint8).reshape(-1, REGISTERS)
    n = g["n_shingles"]
    across = g["i"][0] != g["j"][0]
    for x in range(len(comp) - 1):
        ys = np.arange(x + 1, len(comp))
        ok = (comp[ys] != comp[x]) & (4 * np.minimum(n[ys], n[x]) >= 3 * np.maximum(n[ys], n[x]))
        if across:
            ok &= half[ys] != half[x]
        ys = ys[ok]
        if not len(ys):
            continue
        same = regs[ys] == regs[x]
        enough = same.sum(1) >= LEAST_ESTIMATE * REGISTERS
        if band >= 0 and enough.any():
            enough &= same.reshape(len(ys), BANDS, ROWS).all(2).argmax(1) == band
        ys = ys[enough]
        if len(ys):
            yield x, ys


def shared_counts(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs of sets.

    Items of a single set are left out, those of two are counted by their pair, and the others by
    products of presence matrices, `chunk` items at a time."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.int32)
    if not n:
        return out
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    items, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = rows[np.argsort(at, kind="stable")]  # by item
    first = np.cumsum(times) - times
    two = first[times == 2]
    np.add.at(out, (rows[two], rows[two + 1]), 1)
    out += out.T.copy()
    rows = rows[np.repeat(times > 2, times)]
    cols = np.repeat(np.arange(int((times > 2).sum())), times[times > 2])
    many = int((times > 2).sum())
    for low in range(0, many, chunk):
        a, b = np.searchsorted(cols, [low, low + chunk])
        there = np.zeros((n, min(chunk, many - low)), dtype=np.float32)
        there[rows[a:b], cols[a:b] - low] = 1
        out += (there @ there.T).astype(np.int32)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


_CELL = ["i", "j", "half", "id", "component", "n_shingles", "regs", "band"]


def _pairs_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    joined = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([joined(a), joined(b)], ["a", "b"])


def _merge(label: np.ndarray, nodes: np.ndarray) -> None:
    """Gives all that have a label of one of the nodes the least of these labels."""
    found = np.unique(label[nodes])
    if len(found) > 1:
        label[np.isin(label, found)] = found[0]


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each cell's candidates, as links to a root: at most one row a member."""
    left, right, held = [], [], 0
    for g in _runs(batches, ["key", "i", "j"], _CELL):
        ids, label = g["id"], np.arange(len(g["id"]))
        for x, ys in _candidates(g):
            _merge(label, np.append(ys, x))
        leaf = np.flatnonzero(label != np.arange(len(ids)))
        left.append(ids[leaf])
        right.append(ids[label[leaf]])
        held += len(leaf)
        if held > 50_000:
            yield _pairs_batch(left, right)
            left, right, held = [], [], 0
    trim()
    yield _pairs_batch(left, right)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect all that a cluster's confirmed pairs connect, at most one a member."""
    for g in _runs(batches, ["cluster", "i", "j"], ["i", "j", "half", "id", "component", "items"]):
        ids, half = g["id"], g["half"]
        comps, label = np.unique(g["component"], return_inverse=True)
        if len(comps) == 1:
            continue
        sets = [np.frombuffer(b, dtype=_U64) for b in g["items"]]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        left, right = [], []
        both = shared_counts(sets)
        across = g["i"][0] != g["j"][0]
        for x in range(len(ids)):
            ok = (100 * both[x].astype(np.int64) >= 75 * (n[x] + n - both[x])) & (label != label[x])
            if across:
                ok &= half != half[x]
            ys = np.flatnonzero(ok)
            if len(ys):
                ys = ys[np.unique(label[ys], return_index=True)[1]]
                left.append(np.full(len(ys), ids[x]))
                right.append(ids[ys])
                _merge(label, np.append(ys, x))
        if left:
            yield _pairs_batch(left, right)
    trim()


def _grid(rows: DataFrame, key: str, block: int, items: int = 250_000) -> DataFrame:
    """Deals the rows of each key into pairs of blocks (i, j) of about `block` rows and `items` set items at most, so that every pair of rows meets."""
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / items)).cast("int")
    own = rows.join(rows.groupBy(key).agg(blocks.alias("blocks")), key).withColumn("half", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.withColumn("i", F.least("half", "other")).withColumn("j", F.greatest("half", "other")).drop("other", "blocks")


def _of(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """rows with the component of their id, which is its own where it has no link."""
    if comps is None:
        return rows.withColumn("component", F.col("id"))
    return rows.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _rest(left: DataFrame, waiting: DataFrame, comps: DataFrame, classes: DataFrame, sets: DataFrame, block: int = 256, small: int = SMALL) -> DataFrame:
    """Links between members of a bucket, or of a waiting pair, that still stand in different components.

    left(key, band, id, component): open buckets. Those of at most `small` members go to a task each. Larger ones are joined into
    clusters of buckets that share members, and a cluster is dealt into pairs of blocks: no task
    holds more than two blocks, and a row is copied once a block of its cluster, not once a band. This first pass, over
    registers, returns what its candidate pairs connect; there, and with the waiting pairs(a, b), dealt likewise, pairs are confirmed on sets.
    """
    signed = classes.select("id", "n_shingles", "regs")
    sizes = left.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    whole = left.join(sizes.filter(F.col("n") <= small).select("key"), "key", "left_semi")
    cells = whole.select("key", "band", "id", "component", *[F.lit(0).alias(c) for c in ("half", "i", "j")])
    if sizes.filter(F.col("n") > small).limit(1).count():
        large = cut(left.join(sizes.filter(F.col("n") > small), "key").select("id", "component", "least"))
        met = components(large.select(F.col("id").alias("a"), F.col("least").alias("b"))).withColumnRenamed("component", "key")
        members = large.select("id", "component").distinct().join(met, "id").withColumn("band", F.lit(-1))
        cells = cells.unionByName(_grid(members.join(signed.select("id", "n_shingles"), "id"), "key", block).drop("n_shingles"))
    cells = cells.join(signed, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    clusters = components(cut(cells.mapInArrow(_flag, "a long, b long").unionAll(waiting))).withColumnRenamed("component", "cluster")
    own = _of(clusters, comps).join(signed.select("id", "n_shingles"), "id")
    cells = _grid(own, "cluster", block).join(sets, "id").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return cells.mapInArrow(_confirm, "a long, b long")


def _pivot_rounds(members: DataFrame, classes: DataFrame, sets: DataFrame, enough: float = 0.75, small: int = SMALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Likely pairs that were no document's best, components, and what is left open, (key, band, id, component), after rounds of pivots.

    In a round each open bucket compares its members with a fresh pivot, which then leaves it. Members stand in the
    same order in every bucket, so buckets that share most of their members share pivots, and pairs. Rounds go on while there are
    open buckets of more than `small` members and a round leaves at most `enough` of the open rows.
    """
    comps, waiting, left, n = None, None, _of(members, None), None
    joined = lambda a, b: b if a is None else a.unionAll(b)
    while True:
        place = F.struct(F.xxhash64("id"), "id", "component")
        pivots = left.groupBy("key").agg(F.min(place).alias("p")).select("key", F.col("p.id").alias("pivot"), F.col("p.component").alias("of"))
        met = left.join(pivots, "key").filter("id <> pivot")
        pairs = met.filter("component <> of").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        likely = cut(_likely(pairs, classes))
        ends = likely.select("a", "b", "estimate", F.explode(F.array("a", "b")).alias("end"))
        best = ends.groupBy("end").agg(F.max(F.struct("estimate", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        waiting = joined(waiting, likely.select("a", "b").join(best, ["a", "b"], "left_anti"))
        comps = extended(comps, cut(_confirmed(best, sets)))
        now = _of(met.select("key", "band", "id"), comps)
        opened = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
        left = cut(now.join(opened, "key", "left_semi").select("key", "band", "id", "component"))
        before, n, most = n, *left.groupBy("key").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
        if not n or most <= small or before is not None and n > enough * before:
            break
    side = lambda c: comps.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    across = waiting.distinct().join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    return across.select("a", "b"), comps, left


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Null texts, empty ones and those without words have an empty set, link with nothing and
    are kept. Rows that share a doc_id share a component; a null doc_id has no component and
    is kept. An empty table gives an empty one. Only doc_id and text are read.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    signed = cut(texts.mapInArrow(_sign, "doc_id bigint, n_shingles bigint, digest binary, regs binary"))
    classes = cut(signed.filter("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")))
    bands = _bands(classes)
    buckets = bands.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    members = cut(bands.join(buckets, "key", "left_semi").select("key", "band", "id"))
    # sets of all that share a bucket with anything else, made again from their texts
    wanted = members.select("id").distinct()
    sets = texts.join(wanted, texts["doc_id"] == wanted["id"], "left_semi").mapInArrow(_sets, "id bigint, items binary")
    repeated = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").limit(1).count()
    sets = cut(sets.distinct() if repeated else sets)

    waiting, comps, left = _pivot_rounds(members, classes, sets)
    more = cut(_rest(left, waiting, comps, classes, sets))
    if more.limit(1).count():
        comps = extended(comps, more)

    named = classes.select("digest", F.col("id").alias("class_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").join(comps.withColumnRenamed("id", "class_id"), "class_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
