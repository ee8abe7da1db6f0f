"""Sharding by a hierarchical weighted hash tree (law `key`).

Shards are leaves of a tree region -> rack -> shard. A document descends it: every region
has an exponential draw -ln(u(doc_id, region)) / weight, a region's weight being the sum of
its shards', and the least draw wins; then the racks of that region draw, then the shards
of that rack. A draw depends only on the document, the node and the node's weight. So a
change of a shard's weight changes the draws of that shard, its rack and its region alone: rows
move into or out of that region, within it into or out of that rack, and within that into or out of that shard.

A shard that is added opens a region of its own at the root (`Tree.plus`): it takes rows only into itself.

A placement draws for regions + racks of one region + shards of one rack, not for all shards.
All of it is one projection of built-in expressions; slots are numbered by a two-level
count (cells of a shard, then rows within a cell), so no shard is sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

Node = tuple[str, float, int]


@dataclass(frozen=True)
class Tree:
    """regions[r][k] are the shards (number, weight) of rack k of region r."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    def __post_init__(self):
        weights = [w for region in self.regions for rack in region for _, w in rack]
        if any(w < 0 for w in weights):
            raise ValueError("weights must not be negative")
        if not any(w > 0 for w in weights):
            raise ValueError("a tree needs a shard of positive weight")

    @classmethod
    def of(cls, weights: list[float] | tuple[float, ...], per_rack: int = 5, per_region: int = 4) -> Tree:
        """Shard s stands in rack s // per_rack, rack r in region r // per_region."""
        shards = list(enumerate(map(float, weights)))
        racks = [tuple(shards[i : i + per_rack]) for i in range(0, len(shards), per_rack)]
        return cls(tuple(tuple(racks[i : i + per_region]) for i in range(0, len(racks), per_region)))

    @classmethod
    def even(cls, shards: int, per_rack: int = 5, per_region: int = 4) -> Tree:
        return cls.of((1.0,) * shards, per_rack, per_region)

    def plus(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region of its own."""
        number = 1 + max(s for region in self.regions for rack in region for s, _ in rack)
        return Tree((*self.regions, (((number, float(weight)),),)))

    def root(self) -> list[Node]:
        """(name, weight, number) of the regions of positive weight."""
        return [(f"region-{r}", w, r) for r, region in enumerate(self.regions) if (w := sum(w for rack in region for _, w in rack)) > 0]

    def racks(self, region: int) -> list[Node]:
        return [(f"rack-{region}-{k}", w, k) for k, rack in enumerate(self.regions[region]) if (w := sum(w for _, w in rack)) > 0]

    def shards(self, region: int, rack: int) -> list[Node]:
        return [(f"shard-{s}", w, s) for s, w in self.regions[region][rack] if w > 0]


_NODE = "struct<name:string,weight:double,number:int>"


def _nodes(nodes: list[Node]) -> Column:
    """Nodes as a constant array: data, so that plans and generated code don't grow with the tree."""
    return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(number).alias("number")) for name, weight, number in nodes]).cast(f"array<{_NODE}>")


def _draw(key: Column, nodes: Column) -> Column:
    """The number of the node with the least draw."""
    u = lambda name: (F.pmod(F.xxhash64(key, name), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.array_min(F.transform(nodes, lambda t: F.struct((-F.log(u(t["name"])) / t["weight"]).alias("draw"), t["number"].alias("number"))))["number"]


def place(docs: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """docs with the shard of their key: a draw of regions, then one of the racks of that region, then one of that rack's shards.

    Each level is a column of its own and draws among the nodes below the one that was chosen."""
    region, rack = f"__{name}_region", f"__{name}_rack"
    racks = [tree.racks(r) for r in range(len(tree.regions))]
    shards = [[tree.shards(r, k) for k in range(len(region))] for r, region in enumerate(tree.regions)]
    docs = docs.withColumn(region, _draw(key, _nodes(tree.root())))
    docs = docs.withColumn(rack, _draw(key, F.get(F.array(*[_nodes(r) for r in racks]), F.col(region))))
    leaves = F.array(*[F.array(*[_nodes(k) for k in r]) for r in shards])
    return docs.withColumn(name, _draw(key, F.get(F.get(leaves, F.col(region)), F.col(rack)))).drop(region, rack)


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None, *, row_overhead: int = 16, cells: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, grown_shard, slot.

    Null doc_ids share one key, and so a shard; their slots are dealt by their texts. Repeated rows go to the same shard and get slots of their
    own. A null text has no bytes, a text may be of any length. An empty table gives an empty one. Only doc_id and text
    are read; other columns don't matter.
    """
    text = text_of()
    base = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("key"),
        (F.octet_length(text) + F.lit(row_overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    key = F.col("key")
    base = place(base, key, tree, "shard")
    base = place(base, key, grown, "grown_shard") if grown else base.withColumn("grown_shard", F.lit(None).cast("int"))
    # rows of one key, repeated or null, spread over cells by what they hold
    base = base.withColumn("cell", F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(cells)).cast("int")).drop("key")
    counts = base.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("first_slot"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size"))
    numbered = base.withColumn("rank", rank)
    # at most shards x cells rows, whatever the input
    return numbered.join(F.broadcast(before), ["shard", "cell"]).withColumn("slot", (F.col("first_slot") + F.col("rank") - 1).cast("long")).drop("cell", "rank", "first_slot")


def sharding_query(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The contract's columns over every row of docs, by `assign`: null doc_ids share a shard, null texts have no bytes,
    repeated rows keep their own slots, an empty table gives an empty one, other columns are not read."""
    tree = Tree.even(shards)
    out = assign(docs, tree, tree.plus(), cells=256)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"))
