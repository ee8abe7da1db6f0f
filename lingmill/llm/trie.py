"""Prefix trie of conversations, in succinct level-order shards.

A node is a distinct sequence of first turns. Its key is a running sum over the turns of hashes that
know their place, so keys of a conversation of any length come from sums over partitions of a
sorted table, and the nodes from one aggregation by key.

Below a node of a single conversation nothing is shared: such nodes have one leaf and save nothing. The
others are dealt into prefix shards: a node is heavy if more turns than a shard holds stand below it, and the subtree of
each topmost light node goes into one shard. A shard is a forest in level order: numpy builds its
LOUDS bits (a one for each child, then a zero, for each node) and its label array, reads
parents off the bits, and rolls up from the last level to the first with add.at.

Heavy nodes, the upper levels, are merged apart. Each heavy node's own value and each shard root's
total is held by the node's smallest conversation; a heavy node's total is the sum, over its
members, of what they hold at its depth or deeper: running sums from the deepest turn up, then
an aggregation by key. So neither a deep chain nor a node of all conversations meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, n_space_words, ship_package, trim
from .running import running_sums

LIMBS = ("l0", "l1", "l2", "l3")


class Louds:
    """A forest in level order. bits: ones for the roots and a zero, then for each node ones for its children and a zero."""

    def __init__(self, bits: np.ndarray, labels: np.ndarray):
        self.bits, self.labels = bits, labels
        ones, zeros = np.flatnonzero(bits), np.flatnonzero(~bits)
        #: node i is the i-th one; the zeros before it are the nodes whose children are complete, after the roots' own
        self.parent = ones - np.arange(len(ones)) - 1
        #: the children of what has the j-th zero (0: the roots, j: node j - 1) are the ones before it
        self.child_end = zeros - np.arange(len(zeros))

    @classmethod
    def of(cls, parent: np.ndarray, labels: np.ndarray) -> tuple[Louds, np.ndarray]:
        """From parents in any order (-1: a root); also the nodes in level order. Siblings stand by label, equal ones as they came."""
        n = len(parent)
        by_parent = np.lexsort((labels, parent))
        grouped = parent[by_parent]
        first, last = np.searchsorted(grouped, np.arange(-1, n)), np.searchsorted(grouped, np.arange(-1, n), side="right")
        order, level = [], by_parent[first[0] : last[0]]
        while len(level):
            order.append(level)
            counts = (last - first)[level + 1]
            at = np.repeat(first[level + 1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            level = by_parent[at]
        order = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        degrees = np.concatenate([(last - first)[:1], (last - first)[order + 1]])
        bits = np.ones(int(degrees.sum()) + len(degrees), dtype=bool)
        bits[np.cumsum(degrees + 1) - 1] = False
        return cls(bits, labels[order]), order

    def children(self, node: int) -> range:
        """The children of a node, or the roots for -1."""
        return range(int(self.child_end[node]) if node >= 0 else 0, int(self.child_end[node + 1]))

    def levels(self) -> list[tuple[int, int]]:
        low, high, out = 0, int(self.child_end[0]), []
        while low < high:
            out.append((low, high))
            low, high = high, int(self.child_end[high])
        return out

    def rollup(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, from the last level up."""
        total = values.astype(np.int64)
        for low, high in reversed(self.levels()[1:]):
            np.add.at(total, self.parent[low:high], total[low:high])
        return total


def _key(sums: list[Column], depth: Column) -> Column:
    return F.md5(F.concat_ws(":", *sums, depth).cast("binary"))


def _tags(depth: Column) -> dict[str, Column]:
    """Four numbers of 32 bits from a turn's two hashes and its place; sums over any text fit a long."""
    a, b, low = F.xxhash64("x", depth), F.xxhash64("y", depth), F.lit(0xFFFFFFFF)
    return dict(zip(LIMBS, (a.bitwiseAND(low), F.shiftrightunsigned(a, 32), b.bitwiseAND(low), F.shiftrightunsigned(b, 32))))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos from 1, words and two hashes x and y of role and text, for each turn in order."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).filter("conv_id is not null")
    rows = rows.withColumns({"x": F.xxhash64("role", "text", F.lit(1)), "y": F.xxhash64("role", "text", F.lit(2)), "words": n_space_words(F.col("text")), "one": F.lit(1).cast("long"), "row": F.monotonically_increasing_id()})
    # the row's number deals equal rows to several tasks
    rows = rows.orderBy("conv_id", F.asc_nulls_first("turn"), "role", "text", "row").select("conv_id", "x", "y", "words", "one")
    return running_sums(rows, "conv_id", ["one"]).select("conv_id", F.col("one_sum").alias("pos"), "words", "x", "y")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations, of turns_of: (conv_id, pos, words, x, y), and (conv_id, length).

    Conversation c has the first h turns of c - c % family, then its own after its first h; h = crc32(c) % most.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = cut(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    own = turns.join(convs, "conv_id").filter("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    heads = turns.filter((F.col("pos") < most) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    heads = convs.join(heads, "base").filter("pos <= taken")
    columns = ["conv_id", "pos", "length", "words", "x", "y"]
    return own.select(*columns).unionByName(heads.select(*columns)), convs.select("conv_id", "length")


ROOT = hashlib.md5(b"0:0:0:0:0").hexdigest()


def paths(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, depth, length, words, label, key and parent of every conversation's node at every depth, the root included.

    turns(conv_id, pos, length, words, x, y), pos from 1 without gaps; lengths(conv_id, length) of all conversations.
    """
    rows = turns.select("conv_id", "pos", "length", "words", "x", "y").withColumns(_tags(F.col("pos"))).drop("y").orderBy("conv_id", "pos")
    rows = running_sums(rows, "conv_id", list(LIMBS))
    after, before = [F.col(f"{c}_sum") for c in LIMBS], [F.col(f"{c}_sum") - F.col(c) for c in LIMBS]
    rows = rows.select("conv_id", F.col("pos").alias("depth"), "length", "words", F.col("x").alias("label"), _key(after, F.col("pos")).alias("key"), _key(before, F.col("pos") - 1).alias("parent"))
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", zero.alias("depth"), "length", zero.alias("words"), zero.alias("label"), F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"))
    return rows.unionByName(roots)


def _shard(held: dict[str, list]) -> pa.RecordBatch:
    keys = held["key"]
    index = {k: i for i, k in enumerate(keys)}
    parent = np.fromiter((index.get(p, -1) for p in held["parent"]), dtype=np.int64, count=len(keys))
    louds, order = Louds.of(parent, np.array(held["label"], dtype=np.int64))
    row = {
        "louds": np.packbits(louds.bits).tobytes(),
        "bits": len(louds.bits),
        "labels": louds.labels,
        "nodes": [keys[i] for i in order],
        "leaves": louds.rollup(np.array(held["leaf"], dtype=np.int64)[order]),
        "saved": louds.rollup(np.array(held["own"], dtype=np.int64)[order]),
    }
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in row.values()], list(row))


def _shards(batches: Iterator[pa.RecordBatch], *, size: int) -> Iterator[pa.RecordBatch]:
    """One row per shard of whole units, of rows that are sorted by unit."""
    columns = ("unit", "key", "parent", "label", "leaf", "own")
    held: dict[str, list] = {c: [] for c in columns}
    for batch in batches:
        units = batch.column("unit").to_pylist()
        edges = [0, *[i for i in range(1, len(units)) if units[i] != units[i - 1]], len(units)]
        for low, high in zip(edges[:-1], edges[1:]):
            if low < high and len(held["unit"]) >= size and held["unit"][-1] != units[low]:
                yield _shard(held)
                held = {c: [] for c in columns}
            for c in columns:
                held[c] += batch.column(c).slice(low, high - low).to_pylist()
    if held["unit"]:
        yield _shard(held)
    trim()


def _join_ids(batches: Iterator[pa.RecordBatch], *, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Ids of rows sorted by (key, conv_id), joined by commas, at most `most` of a batch in a row."""
    for batch in batches:
        keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
        edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        rows = [(keys[k], ids[k], ",".join(map(str, ids[k : min(k + most, high)]))) for low, high in zip(edges[:-1], edges[1:]) for k in range(low, high, most)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["key", "first", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's rows, joined by commas; rows are sorted by (key, first) and none is held."""
    last, sha = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([sha.hexdigest()], pa.string())], ["key", "many_sha256"])
    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids")):
            if key != last:
                if sha:
                    yield done()
                last, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.as_py().encode())
    if sha:
        yield done()


def ends_digests(ends: DataFrame) -> DataFrame:
    """key, many_sha256: the digest of the ascending ids of each key of ends(key, conv_id).

    A digest of one text is made in order, so one task reads a key's text; ids are sorted and joined before, by as many tasks as there are, in rows of 65,536 ids.
    """
    joined = ends.orderBy("key", "conv_id").select("key", "conv_id").mapInArrow(_join_ids, "key string, first long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digest, "key string, many_sha256 string")


def shards_of(shared: DataFrame, units: DataFrame, shard: int) -> DataFrame:
    """LOUDS shards of light nodes: louds, bits (how many), labels, nodes, and their rollups leaves and saved.

    units(conv_id, unit) has the topmost light node of each conversation's path."""
    light = shared.filter("not heavy").join(units, "conv_id").select("unit", "depth", "key", "parent", "label", "leaf", "own")
    dealt = light.repartition("unit").sortWithinPartitions("unit", "depth")
    return dealt.mapInArrow(partial(_shards, size=shard), "louds binary, bits long, labels array<long>, nodes array<string>, leaves array<long>, saved array<long>")


def prefix_trie(rows: DataFrame, *, shard: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Nodes and LOUDS shards of the trie of paths(): each node's key, parent, depth, conv_id (smallest member), parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256. An empty table gives no node.

    A node is heavy if more than `shard` turns stand below it.
    """
    ship_package(rows.sparkSession)
    rows = cut(rows)
    ended = F.col("depth") == F.col("length")
    nodes = rows.groupBy("key", "parent").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("label").alias("label"), F.max("words").alias("words"), F.count("*").alias("n_convs"),
        F.count_if(ended).alias("n_ends"), F.min(F.when(ended, F.col("conv_id"))).alias("end"), F.sum(F.col("length") - F.col("depth")).alias("below"),
    )
    nodes = cut(nodes)
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = cut(nodes.join(kids, "key", "left").join(above, "parent", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "lone": F.coalesce("lone", F.lit(0))}))

    alone = (F.col("n_convs") == 1) & (F.col("depth") > 0)
    leaf = F.col("lone") + (F.col("n_children") == 0).cast("long")
    shared = nodes.filter(~alone).withColumns({"heavy": (F.col("below") > shard) | (F.col("depth") == 0), "leaf": leaf, "own": (F.col("n_convs") - 1) * F.col("words")})
    on_path = cut(rows.filter("depth > 0").select("conv_id", "depth", "key").join(shared.select("key", "heavy"), "key"))
    units = on_path.filter("not heavy").groupBy("conv_id").agg(F.min_by("key", "depth").alias("unit"))
    shards = cut(shards_of(shared, units, shard))
    rolled = shards.select(F.explode(F.arrays_zip("nodes", "leaves", "saved")).alias("t")).select(F.col("t.nodes").alias("key"), F.col("t.leaves").alias("n_leaves"), F.col("t.saved").alias("saved_tokens"))

    held = shared.filter("heavy").select("conv_id", "depth", F.col("leaf").alias("leaves"), F.col("own").alias("saved"))
    tops = shared.filter("not heavy").join(units, "conv_id").filter("key = unit").select("key", "conv_id", "depth")
    held = held.unionByName(tops.join(rolled, "key").select("conv_id", "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))).withColumn("key", F.lit(None).cast("string"))
    members = on_path.filter("heavy").select("conv_id", "depth", "key").unionByName(rows.filter("depth = 0").select("conv_id", "depth", "key"))
    members = members.withColumns({"leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
    # from the deepest turn up; what is held at a depth comes before the members there
    events = members.unionByName(held).orderBy("conv_id", F.desc("depth"), F.asc_nulls_first("key"))
    upper = running_sums(events, "conv_id", ["leaves", "saved"]).filter("key is not null").groupBy("key").agg(F.sum("leaves_sum").alias("n_leaves"), F.sum("saved_sum").alias("saved_tokens"))

    ends = rows.filter(ended).select("key", "conv_id").join(nodes.filter("n_ends > 1").select("key"), "key", "left_semi")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    # a null end is a node where nothing ends
    out = nodes.join(rolled.unionByName(upper), "key", "left").join(ends_digests(ends), "key", "left")
    out = out.withColumns({"n_leaves": F.coalesce("n_leaves", F.lit(1)), "saved_tokens": F.coalesce("saved_tokens", F.lit(0)), "ends_sha256": F.coalesce("many_sha256", sha(F.coalesce(F.col("end").cast("string"), F.lit(""))))})
    return out.select("key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), shards


def trie_query(conversations: DataFrame, *, shard: int = 200_000) -> DataFrame:
    """The contract's columns, one row per node.

    Turns go by number, null first, then by role and text where a number repeats; repeated rows are turns of their own.
    Null roles and texts are empty; rows of a null conv_id take no part. c % 20 has the sign of c. An empty table gives no row. Other columns are not read.
    """
    nodes, _ = prefix_trie(paths(*rebuilt(turns_of(conversations))), shard=shard)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
