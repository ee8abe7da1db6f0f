"""Connected components of a link table, by alternating large-star and small-star contractions.

Each round is two aggregations keyed by node; hubs are pre-aggregated with min() before the
shuffle, their links join by the node's complement, whose own exchange lets AQE split a hub
(a join that reuses the aggregation's exchange can't be split), and the link table is cut in the shared checkpoint folder twice a round. Rounds
end when the links are stars. Their number is logarithmic in the longest path, and nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.bitwise_not("a").alias("of"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.bitwise_not("a") == F.col("of")).select(F.col("m").alias("a"), "b").filter("a <> b")


def _small_star(e: DataFrame) -> DataFrame:
    # every row is (smaller, larger); each node joins its smaller neighbours under their least, itself by one row
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    other = least.select(F.bitwise_not("b").alias("of"), "m")
    joined = e.join(other, (F.bitwise_not("b") == F.col("of")) & (F.col("a") != F.col("m")))
    return least.select(F.col("m").alias("a"), "b").unionAll(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every larger end has one smaller end, which is nobody's larger end."""
    ends = e.select(F.col("a").alias("x"), F.lit(1).alias("centre"), F.lit(0).alias("leaf")).unionAll(e.select(F.col("b").alias("x"), F.lit(0).alias("centre"), F.lit(1).alias("leaf")))
    per = ends.groupBy("x").agg(F.max("centre").alias("centre"), F.sum("leaf").alias("leaf"))
    return not per.filter("leaf > 1 or (centre = 1 and leaf = 1)").limit(1).count()


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """links(a, b): pairs of long ids, of a materialised table. Returns (id, component): one row per id in a link,
    component being the smallest id reachable. An empty table gives an empty one; repeated
    links, loops and either orientation are allowed; rows with a null id are no links."""
    e = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    n = e.count()
    for _ in range(max_rounds if n else 0):
        # few tasks write what few rows need, whatever the number of shuffle partitions; the small star reads the large one three times
        large = cut(_large_star(e).coalesce(8 + n // 100_000))
        e = cut(_small_star(large).coalesce(8 + n // 100_000))
        if _stars(e):
            break
    else:
        if n:
            raise RuntimeError("components did not settle")
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).union(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def extended(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """comps, as components returns them, after more links(a, b): only these are contracted, between the components of their ends.

    Both are materialised tables, without nulls; what is returned is one too."""
    if comps is None:
        return components(links)
    side = lambda c: comps.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    ends = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    met = components(cut(ends.filter("a <> b").distinct()))
    moved = comps.join(met.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return cut(moved.unionAll(met.join(comps, "id", "left_anti")))
