"""Cross-lingual retrieval: nearest neighbours between languages, error rates and margins.

Embeddings are (lang, id, emb). Neighbours come from blocks: each task multiplies a
block of queries with a block of targets, of any languages, and keeps the k best per query and language (see meeting.py);
a window then merges what blocks found. Cone bounds (see cones.py) leave out products where
languages pass a block. Memory is bounded by the block size, and no
similarity matrix is ever made whole. The SQL form in sql_nearest gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalise
from ..session import compiled, cut, ship_package
from .cones import cone_nearest, ranked
from .meeting import TASKS, dealt, grid, sides
from .ordering import number_within

MARGINS = ("absolute", "ratio", "distance")
#: Rows of a group of queries or targets that meet in built-in expressions, at most.
GROUP = 4096


def check_margin(margin: str) -> str:
    if margin not in MARGINS:
        raise ValueError(f"margin must be one of {', '.join(MARGINS)}, not {margin!r}")
    return margin


def positions(emb: DataFrame) -> DataFrame:
    """Numbers each language's rows from 0: ids from 0 on upwards, then negative ids from -1 on downwards."""
    order = [F.col("id") < 0, F.when(F.col("id") >= 0, F.col("id")), -F.col("id")]
    return number_within(emb, ["lang"], order, "pos")


def nearest(queries: DataFrame, targets: DataFrame, pair: Column, k: int, block: int = 131_072) -> DataFrame:
    """The k most similar targets of each query: src, tgt, i, j, sim, rank; ties go to the smaller position.

    queries and targets are (lang, pos, emb); pair is a condition over src and tgt. Languages of more than a block of
    targets are searched by cones; smaller ones have a single block, which there is nothing to skip of.
    """
    ship_package(queries.sparkSession)
    largest = targets.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    return cone_nearest(queries, targets, pair, k, block=block) if largest > block else grid_nearest(queries, targets, pair, k, block)


def grid_nearest(queries: DataFrame, targets: DataFrame, pair: Column, k: int, block: int = 131_072) -> DataFrame:
    """nearest by every block of queries with every block of targets."""
    ship_package(queries.sparkSession)
    own = lambda df: df.select("lang", "pos", "emb")
    return ranked(grid(own(queries), own(targets), pair, k, block=block).drop("wave"), k)


def sql_nearest(queries: DataFrame, targets: DataFrame, pair: Column, k: int, block: int = 512) -> DataFrame:
    """nearest in built-in expressions; all products are made, so the time is quadratic.

    Groups of queries meet groups of targets, with a column a dimension, so that products are compiled code; of each query and block of
    targets at consecutive positions the largest similarity is left. The k best of a query are in the k blocks of the largest
    ones (of equal ones the first), and only those are gone through for positions. Without a component a vector is similar to none and comes last.
    """
    spark = queries.sparkSession
    dim = targets.agg(F.max(F.size("emb")).alias("n")).first().n or 0
    with compiled(spark, 2 * dim):
        units = _units(queries, dim)
        q, t = _side(units, dim, "src", "i", "_x"), _side(units if targets is queries else _units(targets, dim), dim, "tgt", "j", "_y").withColumn("_b", F.floor(F.col("j") / block))
        near = _met(q, t, pair, dim).groupBy("src", "tgt", "i", "_b").agg(F.min("less").alias("less"))
        own = Window.partitionBy("src", "tgt", "i")
        first = near.withColumn("_rank", F.row_number().over(own.orderBy("less", "_b"))).filter(F.col("_rank") <= k)
        # with fewer than k blocks all that they hold may be among the best
        reach = F.when(F.count("*").over(own) == k, F.max("less").over(own)).otherwise(F.lit(float("nan")))
        first = cut(first.select("src", "tgt", "i", "_b", reach.alias("_reach")))
        found = _opened(first, q, t, dim).filter(F.col("less") <= F.col("_reach"))
        if k == 1:  # all of equal similarity
            found = found.groupBy("src", "tgt", "i").agg(F.min("less").alias("less"), F.min("j").alias("j"))
        else:
            found = found.withColumn("_rank", F.row_number().over(own.orderBy("less", "j"))).filter(F.col("_rank") <= k)
        found = cut(found.select("src", "tgt", "i", F.struct("less", "j").alias("_n")))
    best = found.repartition(TASKS, "src", "i").groupBy("src", "tgt", "i").agg(F.collect_list("_n").alias("_best"))
    kept = F.array(F.array_min("_best")) if k == 1 else F.array_sort("_best")
    return best.select("src", "tgt", "i", F.posexplode(kept).alias("_at", "_n")).select("src", "tgt", "i", F.col("_n.j").alias("j"), (F.lit(0.0) - F.col("_n.less")).alias("sim"), (F.col("_at") + 1).alias("rank"))


def _units(emb: DataFrame, dim: int) -> DataFrame:
    """lang, pos and the components of unit vectors as columns, made once; what is missing is NaN."""
    unit = emb.select("lang", F.col("pos").cast("long").alias("pos"), l2_normalise(F.col("emb")).alias("_u"))
    return cut(unit.select("lang", "pos", *[F.coalesce(F.get("_u", F.lit(n)), F.lit(float("nan"))).alias(f"_{n}") for n in range(dim)]))


def _side(units: DataFrame, dim: int, lang: str, pos: str, name: str) -> DataFrame:
    return units.select(F.col("lang").alias(lang), F.col("pos").alias(pos), *[F.col(f"_{n}").alias(f"{name}{n}") for n in range(dim)])


def _less(dim: int) -> Column:
    """The similarity below zero, so that the smallest is the best and NaN comes last. Four sums, which do not wait for each other."""
    terms = [F.col(f"_x{n}") * F.col(f"_y{n}") for n in range(dim)] or [F.lit(0.0)]
    return (F.lit(0.0) - sum((sum(terms[w + 4 :: 4], terms[w]) for w in range(1, min(4, len(terms)))), sum(terms[4::4], terms[0]))).alias("less")


def _met(q: DataFrame, t: DataFrame, pair: Column, dim: int) -> DataFrame:
    """Every query with every target: src, tgt, i, _b, less. Vectors are copied once for each group of the other side."""
    q, t = q.withColumnRenamed("i", "pos"), t.withColumnRenamed("j", "pos")
    q_counts, t_counts = q.groupBy("src").agg(F.count("*").alias("n")), t.groupBy("tgt", "_b").agg(F.count("*").alias("n"))
    n_q, n_t = (c.agg(F.sum("n").alias("n")).first().n or 0 for c in (q_counts, t_counts))
    g_q, g_t = sides(n_q, n_t, GROUP)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = dealt(q, q_counts, ["src"], n_q, g_q, "_qg").withColumn("_tg", every(g_t))
    t = dealt(t, t_counts, ["tgt", "_b"], n_t, g_t, "_tg").withColumn("_qg", every(g_q))
    by = ["_qg", "_tg"]
    q, t = (df.repartition(2 * g_q * g_t, *by) for df in (q, t))
    return q.withColumnRenamed("pos", "i").join(t.drop("pos"), by).filter(pair).select("src", "tgt", "i", "_b", _less(dim))


def _opened(first: DataFrame, q: DataFrame, t: DataFrame, dim: int, shares: int = 8) -> DataFrame:
    """The queries of first(src, tgt, i, _b, _reach) with all targets of that block: src, tgt, i, _reach, j, less. A block that many queries open is met in shares of them."""
    by = ["tgt", "_b", "_share"]
    q = first.join(q, ["src", "i"]).withColumn("_share", F.pmod(F.xxhash64("src", "i"), F.lit(shares)).cast("int"))
    t = t.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    q, t = (df.repartition(4 * TASKS, *by) for df in (q, t))
    return q.join(t, by).select("src", "tgt", "i", "_reach", "j", _less(dim))


def different() -> Column:
    return F.col("src") != F.col("tgt")


def errors(best: DataFrame) -> DataFrame:
    """Per language pair, how many queries' best target isn't the one at their own position."""
    return best.groupBy("src", "tgt").agg(F.count_if(F.col("i") != F.col("j")).alias("err"), F.count("*").alias("n"))


def xsim(emb: DataFrame, targets: DataFrame | None = None, *, margin: str = "absolute", k: int = 4, pair: Column | None = None, align: str = "position", search=nearest) -> DataFrame:
    """Errors per directed language pair: src, tgt, err, n.

    targets may add hard negatives. align="id" compares ids instead of positions.
    """
    check_margin(margin)
    if align not in ("position", "id"):
        raise ValueError(f"no such alignment: {align}")
    number = positions if align == "position" else lambda df: df.withColumn("pos", F.col("id").cast("long"))
    q = number(emb)
    t = q if targets is None else number(targets)  # the same rows are numbered, and indexed, once
    both_ways = pair is None and targets is None  # every pair is searched in either direction
    pair = different() if pair is None else pair
    if margin == "absolute":
        return errors(search(q, t, pair, 1))
    return errors(margin_best(q, t, pair, margin=margin, k=k, search=search, both_ways=both_ways))


def margin_best(q: DataFrame, t: DataFrame, pair: Column, *, margin: str, k: int, search=nearest, both_ways: bool = False) -> DataFrame:
    """The forward neighbour of the best margin over both sides' mean similarity to their own k neighbours.

    both_ways: q and t are the same rows and pair holds in either direction, so one search has the neighbours of both sides.
    """
    forward = cut(search(q, t, pair, k))
    backward = (forward if both_ways else search(t, q, pair, k)).select(F.col("src").alias("tgt"), F.col("tgt").alias("src"), F.col("i").alias("j"), "sim")
    ahead = forward.groupBy("src", "tgt", "i").agg(F.avg("sim").alias("ax"))
    back = backward.groupBy("src", "tgt", "j").agg(F.avg("sim").alias("ay"))
    both = forward.join(ahead, ["src", "tgt", "i"]).join(back, ["src", "tgt", "j"])
    base = (F.col("ax") + F.col("ay")) / 2
    score = F.try_divide(F.col("sim"), base) if margin == "ratio" else F.col("sim") - base
    return both.groupBy("src", "tgt", "i").agg(F.max(F.struct(score.alias("score"), (-F.col("j")).alias("less")))["less"].alias("less")).select("src", "tgt", "i", (-F.col("less")).alias("j"))


def error_rate(errs: DataFrame) -> DataFrame:
    return errs.withColumn("xsim", F.round(F.try_divide(100.0 * F.col("err"), F.col("n")), 6))


def micro_average(errs: DataFrame, min_sents: int = 0) -> DataFrame:
    """One row: error over all pairs of at least min_sents queries, and how many pairs were left out."""
    used = F.col("n") >= min_sents
    return errs.agg(F.round(F.try_divide(100.0 * F.sum(F.when(used, F.col("err"))), F.sum(F.when(used, F.col("n")))), 6).alias("xsim"), F.count_if(used).alias("pairs"), F.count_if(~used).alias("skipped"))


def average_by_source(errs: DataFrame) -> DataFrame:
    """Mean error of each source over other targets."""
    return error_rate(errs.filter(different())).groupBy("src").agg(F.round(F.avg("xsim"), 6).alias("avg_xsim"))


def matrix(errs: DataFrame, langs: list[str]) -> DataFrame:
    """Sources as rows, targets as columns."""
    return error_rate(errs).groupBy("src").pivot("tgt", langs).agg(F.first("xsim"))
