"""Evaluation metrics: corpus BLEU, subset means, word error rate, losses, learning-rate schedules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from ..functions.text import strip
from ..session import ship_package


def tokens(c: Column, how: str = "whitespace") -> Column:
    if how == "whitespace":
        return F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")
    if how == "char":
        return F.filter(F.split(c, ""), lambda w: (w != "") & (w != " "))
    raise ValueError(f"no such tokenisation: {how}")


def subwords(path: str) -> Callable[[Column], Column]:
    """A tokenisation by the pieces of a sentencepiece model at path, which all executors reach."""

    @F.arrow_udf(ArrayType(StringType()))
    def pieces(texts: pa.Array) -> pa.Array:
        return pa.array(_pieces_of(path).encode(texts.to_pylist(), out_type=str), pa.list_(pa.string()))

    return lambda c: pieces(c)


@lru_cache(maxsize=2)
def _pieces_of(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows, and each word's row."""
    return lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def clipped_matches(hyp: pa.Array, ref: pa.Array, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n up to order, every row's number of n-grams of hyp that ref holds too, each at most as often, and of all of hyp.

    An n-gram's number is the rank of its first n - 1 words' number and its last word, so equal numbers are equal grams."""
    (h, h_row), (r, r_row) = _flat(hyp), _flat(ref)
    words = pc.dictionary_encode(pa.concat_arrays([h, r])).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row, side = np.concatenate([h_row, r_row]), np.repeat([0, 1], [len(h), len(r)])
    gram, at, out = words, np.arange(len(words)), []
    kinds = int(words.max()) + 1 if len(words) else 1
    for n in range(1, order + 1):
        if n > 1:
            last = at + n - 1
            inside = last < len(words)
            inside[inside] = (row[last[inside]] == row[at[inside]]) & (side[last[inside]] == side[at[inside]])
            at, gram = at[inside], gram[inside]
            gram = np.unique(gram * kinds + words[at + n - 1], return_inverse=True)[1].astype(np.int64)
        key = row[at] * (int(gram.max()) + 1 if len(gram) else 1) + gram
        mine = side[at] == 0
        keys, times = np.unique(key[mine], return_counts=True)
        other, there = np.unique(key[~mine], return_counts=True)
        _, i, j = np.intersect1d(keys, other, assume_unique=True, return_indices=True)
        matched = np.zeros(len(hyp), dtype=np.int64)
        first = np.zeros(len(keys), dtype=np.int64)
        first[i] = np.minimum(times[i], there[j])
        width = int(gram.max()) + 1 if len(gram) else 1
        np.add.at(matched, keys // width, first)
        out.append((matched, np.bincount(row[at][mine], minlength=len(hyp))))
    return out


def _matcher(by: int, order: int, at_once: int = 2048):
    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                hyp, ref = (batch.column(by + k).combine_chunks() if isinstance(batch.column(by + k), pa.ChunkedArray) else batch.column(by + k) for k in (0, 1))
                counts = [pa.array(c) for pair in clipped_matches(hyp, ref, order) for c in pair]
                lengths = [pc.cast(x.value_lengths(), pa.int64()) for x in (hyp, ref)]
                names = [f"{x}{k}" for k in range(1, order + 1) for x in "mt"]
                yield pa.RecordBatch.from_arrays([*batch.columns[:by], *counts, *lengths], [*batch.schema.names[:by], *names, "hyp_len", "ref_len"])

    return run


def corpus_bleu(df: DataFrame, by: Sequence[str], hyp: str = "preds", ref: str = "labels", *, order: int = 4, tokenize: str | Callable[[Column], Column] = "whitespace") -> DataFrame:
    """BLEU per group: clipped n-gram precisions up to `order` over the whole group, brevity
    penalty, and exponential smoothing: the k-th order without a match counts 1 / 2^k matches.

    Clipping is local to a row, so n-grams are counted where the row is, a batch at a time, and only the sums of
    each group are shuffled: no text moves.
    """
    ship_package(df.sparkSession)
    words = tokenize if callable(tokenize) else lambda c: tokens(c, tokenize)
    base = df.select(*by, words(F.coalesce(F.col(hyp), F.lit(""))).alias("_h"), words(F.coalesce(F.col(ref), F.lit(""))).alias("_r"))
    sums = [f"{x}{k}" for k in range(1, order + 1) for x in "mt"]
    schema = base.select(*by).schema
    for name in (*sums, "hyp_len", "ref_len"):
        schema = schema.add(name, "long")
    counted = base.mapInArrow(_matcher(len(by), order), schema)
    stats = counted.groupBy(*by).agg(*[F.sum(c).cast("double").alias(c) for c in sums], F.sum("hyp_len").alias("hyp_len"), F.sum("ref_len").alias("ref_len"))
    logs, halvings = F.lit(0.0), F.lit(0)
    for k in range(1, order + 1):
        m, t = F.col(f"m{k}"), F.col(f"t{k}")
        halvings = halvings + (m == 0).cast("int")
        logs = logs + F.log(F.when(m > 0, m).otherwise(F.pow(F.lit(2.0), -halvings)) / F.greatest(t, F.lit(1.0)))
    h, r = F.col("hyp_len").cast("double"), F.col("ref_len").cast("double")
    penalty = F.when(h >= r, F.lit(1.0)).when(h > 0, F.exp(1 - F.try_divide(r, h))).otherwise(0.0)
    bleu = F.when((F.col("m1") > 0) & (F.col(f"t{order}") > 0), 100 * penalty * F.exp(logs / order)).otherwise(0.0)
    return stats.select(*by, F.round(bleu, 6).alias("bleu"), "hyp_len", "ref_len")


def subset_means(df: DataFrame, value: str, pivot: str = "eng_Latn", source: str = "source_langs", target: str = "target_langs") -> DataFrame:
    """Means over all pairs, from the pivot's, into it, and of a language with itself; null where there is none."""
    s, t = F.col(source), F.col(target)
    mean = lambda c: F.round(F.avg(F.when(c, F.col(value))), 6)
    return df.agg(mean(F.lit(True)).alias("avg_all"), mean((t == pivot) & (s != pivot)).alias("avg_to_pivot"), mean((s == pivot) & (t != pivot)).alias("avg_from_pivot"), mean(s == t).alias("avg_identity"))


def word_edits(ref: Sequence, hyp: Sequence) -> int:
    """Edit distance in words."""
    row = list(range(len(hyp) + 1))
    for i, a in enumerate(ref, 1):
        diagonal, row[0] = row[0], i
        for j, b in enumerate(hyp, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (a != b))
    return row[-1]


def long_edits(ref: Sequence[int], hyp: Sequence[int]) -> int:
    """Edit distance by bit vectors of any length: bit i of a whole number stands for ref[i], and a step takes a word of hyp."""
    m = len(ref)
    if not m:
        return len(hyp)
    places: dict[int, int] = {}
    for i, w in enumerate(ref):
        places[w] = places.get(w, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, edits = every, 0, m  # where a cell is one more, or one less, than the cell above it
    for w in hyp:
        eq = places.get(w, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | (every & ~(h | up)), up & h
        edits += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & every, (less << 1) & every
        up, down = less | (every & ~(x | more)), more & x
    return edits


def short_edits(ref: np.ndarray, n_ref: np.ndarray, hyp: np.ndarray, n_hyp: np.ndarray) -> np.ndarray:
    """long_edits of many pairs at a time, whose references have 1 to 64 words: rows of word numbers, n_ref and n_hyp of them."""
    order = np.argsort(-n_hyp, kind="stable")
    ref, n_ref, hyp, n_hyp = ref[order], n_ref[order], hyp[order], n_hyp[order]
    ref = np.where(np.arange(ref.shape[1])[None, :] < n_ref[:, None], ref, -1)
    ref = np.pad(ref, ((0, 0), (0, 64 - ref.shape[1])), constant_values=-1)
    one = np.uint64(1)
    up, down = np.full(len(ref), ~np.uint64(0)), np.zeros(len(ref), dtype=np.uint64)
    edits, last = n_ref.astype(np.int64), (n_ref - 1).astype(np.uint64)
    for t in range(int(n_hyp[0]) if len(n_hyp) else 0):
        k = int(np.searchsorted(-n_hyp, -t))  # pairs that have a word left come first
        eq = np.packbits(ref[:k] == hyp[:k, t, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        u, d = up[:k], down[:k]
        x = eq | d
        with np.errstate(over="ignore"):
            h = (((eq & u) + u) ^ u) | eq
        more, less = d | ~(h | u), u & h
        edits[:k] += ((more >> last[:k]) & one).astype(np.int64) - ((less >> last[:k]) & one).astype(np.int64)
        more, less = (more << one) | one, less << one
        up[:k], down[:k] = less | ~(x | more), more & x
    out = np.empty_like(edits)
    out[order] = edits
    return out


def _rows(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of numbers from runs of codes, filled up with -2."""
    width = int(lengths.max(initial=0))
    at = starts[:, None] + np.arange(width)[None, :]
    return np.where(np.arange(width)[None, :] < lengths[:, None], codes[np.minimum(at, max(0, len(codes) - 1))] if len(codes) else -2, -2)


def batch_edits(ref: pa.ListArray, hyp: pa.ListArray, cells: int = 1 << 22) -> np.ndarray:
    """Edit distance of each pair of word lists."""
    a, b = ref.flatten(), hyp.flatten()
    codes = pa.concat_arrays([a, b]).dictionary_encode().indices.to_numpy().astype(np.int32)
    n_ref, n_hyp = ref.value_lengths().to_numpy().astype(np.int64), hyp.value_lengths().to_numpy().astype(np.int64)
    at_ref, at_hyp = np.cumsum(n_ref) - n_ref, len(a) + np.cumsum(n_hyp) - n_hyp
    out = np.where(n_ref == 0, n_hyp, n_ref)
    short = np.flatnonzero((n_ref > 0) & (n_ref <= 64) & (n_hyp > 0) & (n_hyp <= 1024))
    short = short[np.argsort(n_hyp[short], kind="stable")]
    low = 0
    while low < len(short):
        # lengths rise, so a chunk's last pair has its widest row
        high = low + max(1, int(np.searchsorted(np.arange(1, len(short) - low + 1) * (64 + n_hyp[short[low:]]), cells, side="right")))
        own = short[low:high]
        out[own] = short_edits(_rows(codes, at_ref[own], n_ref[own]), n_ref[own], _rows(codes, at_hyp[own], n_hyp[own]), n_hyp[own])
        low = high
    for i in np.flatnonzero((n_ref > 64) & (n_hyp > 0) | (n_ref > 0) & (n_hyp > 1024)):
        out[i] = long_edits(codes[at_ref[i] : at_ref[i] + n_ref[i]].tolist(), codes[at_hyp[i] : at_hyp[i] + n_hyp[i]].tolist())
    return out


@F.arrow_udf(LongType())
def _edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return pa.array(batch_edits(ref, hyp), pa.int64())


def word_error_rate(df: DataFrame, by: Sequence[str], hyp: str = "preds", ref: str = "labels") -> DataFrame:
    """100 x word edits over reference words, over each whole group. Edits are counted by bit vectors, an Arrow batch at a time."""
    ship_package(df.sparkSession)
    own = lambda c: tokens(F.coalesce(F.col(c), F.lit("")))
    base = df.select(*by, own(ref).alias("r"), own(hyp).alias("h")).select(*by, _edits("r", "h").alias("edits"), F.size("r").alias("words"))
    return base.groupBy(*by).agg(F.round(F.try_divide(100.0 * F.sum("edits"), F.sum("words")), 6).alias("wer"))


def smoothed_cross_entropy(logits: Column, label: Column, epsilon: float = 0.1, ignored: int = -100) -> Column:
    """(1 - epsilon) x negative log likelihood + epsilon x mean negative log probability; null for ignored labels."""
    most = F.array_max(logits)
    total = F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - most))) + most
    nll = total - F.element_at(logits, (F.when(label == ignored, 0).otherwise(label) + 1).cast("int"))
    mean = total - F.aggregate(logits, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(logits)
    return F.when(label != ignored, (1 - epsilon) * nll + epsilon * mean)


def inverse_sqrt_schedule(spark: SparkSession, steps: int, *, warmup: int, timescale: float | None = None, least: float = 1e-3) -> DataFrame:
    """(step, factor): linear warm-up from `least`, then 1 / sqrt((step + shift) / timescale), shifted to be continuous."""
    timescale = float(timescale or max(1, warmup))
    shift = timescale - warmup
    t = F.col("id").cast("double")
    factor = F.when(t < warmup, least + (1 - least) * t / max(1, warmup)).otherwise(1 / F.sqrt((t + shift) / timescale))
    return spark.range(steps).select(F.col("id").alias("step"), F.round(factor, 9).alias("factor"))


def grouped_schedules(spark: SparkSession, steps: int, *, warmup: int, timescale: int | None = None, specific: str = "specific", others: Sequence[str] = ("shared", "other")) -> DataFrame:
    """(name, step, factor) per parameter group: the specific one decays from the start, on half the timescale."""
    timescale = timescale or warmup or 10_000
    plans = [(g, warmup, timescale) for g in others] + [(specific, 0, timescale // 2)]
    each = [inverse_sqrt_schedule(spark, steps, warmup=w, timescale=t).select(F.lit(g).alias("name"), "step", "factor") for g, w, t in plans]
    return reduce(DataFrame.unionByName, each)


def poisson_pmf(spark: SparkSession, rate: float = 3.0, most: int = 128, least: float = 1e-7) -> DataFrame:
    """(k, p): the law of span lengths, cut off at `most` or where it falls under `least`."""
    k = F.col("id")
    factors = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    p = F.exp(F.aggregate(factors, F.lit(-float(rate)), lambda s, j: s + F.log(F.lit(float(rate)) / j)))
    rows = spark.range(most).select(k.cast("int").alias("k"), F.round(p, 12).alias("p"))
    return rows.filter((F.col("p") >= least) | (F.col("k") <= rate))


def accumulation_steps(total: int, per_device: int, world: int) -> int:
    return total // (per_device * world) + 1


def sort_buffer(per_device: int, accumulation: int, ratio: int) -> int:
    return per_device * accumulation * ratio
