"""Language identification by a linear model over hashed character n-grams.

The model is naive Bayes: a language's weight of a bucket is the log of its share of the language's n-grams. Training is one pass that
counts buckets by language, an Arrow batch at a time and summed before and after the shuffle, for any number of languages. The
model is a matrix of languages by buckets, whatever the number of texts, and goes to the executors as a broadcast.

An n-gram's bucket is plain arithmetic on its code points, so that SQL can make the same buckets:
(sum of (code point + 1) * MULTIPLIERS[i], plus its order, mod 2^32) * MIX mod 2^32, its upper `bits` bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship_package
from .mapping import pieces

MULTIPLIERS = (1_000_003, 40_503_001, 1_566_083_941, 2_038_074_743)
MIX = 2_083_697_005
ORDERS = (1, 2, 3)
BITS = 16


def code_points(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, one after the other, and where each text ends."""
    texts = [t or "" for t in texts]
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.cumsum([len(t) for t in texts], dtype=np.int64)


def buckets(points: np.ndarray, ends: np.ndarray, order: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each n-gram of an order that lies in one text."""
    n = max(0, len(points) - order + 1)
    text = np.searchsorted(ends, np.arange(n), side="right")
    h = np.full(n, order, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(order):
            h += (points[i : i + n] + np.uint32(1)) * np.uint32(MULTIPLIERS[i])
        h *= np.uint32(MIX)
    inside = np.arange(n) + order <= ends[text] if n else np.zeros(0, dtype=bool)
    return (h >> np.uint32(32 - bits)).astype(np.int64)[inside], text[inside]


def _slices(texts: list, most: int = 1 << 19) -> Iterator[slice]:
    """Runs of texts of about `most` characters, or a single text."""
    low = held = 0
    for i, t in enumerate(texts):
        if i > low and held + len(t or "") > most:
            yield slice(low, i)
            low, held = i, 0
        held += len(t or "")
    if low < len(texts):
        yield slice(low, len(texts))


def _count(batches: Iterator[pa.RecordBatch], *, orders: tuple[int, ...], bits: int, most: int = 64) -> Iterator[pa.RecordBatch]:
    """Counts of (label, bucket) of a task; at most `most` labels are held at a time."""
    held: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        found = [(k, np.flatnonzero(v), v) for k, v in held.items()]
        labels = pa.array([k for k, at, _ in found for _ in range(len(at))], pa.string())
        rows = pa.RecordBatch.from_arrays([labels, pa.array(np.concatenate([at for _, at, _ in found])), pa.array(np.concatenate([v[at] for _, at, v in found]))], ["label", "bucket", "n"])
        held.clear()
        return rows

    for batch in pieces(batches):
        labels, texts = batch.column("label").to_pylist(), batch.column("text").to_pylist()
        for own in _slices(texts):
            points, ends = code_points([t.lower() for t in texts[own]])
            names, code = np.unique(np.array(labels[own], dtype=object), return_inverse=True)
            for order in orders:
                b, text = buckets(points, ends, order, bits)
                for i, name in enumerate(names):
                    if name not in held:
                        if len(held) >= most:
                            yield out()
                        held[name] = np.zeros(1 << bits, dtype=np.int64)
                    held[name] += np.bincount(b[code[text] == i], minlength=1 << bits)
    if held:
        yield out()


def bucket_counts(df: DataFrame, text: str = "text", label: str = "lang", *, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> DataFrame:
    """label, bucket, n over lower-cased texts. Rows of a null label or text count nothing."""
    ship_package(df.sparkSession)
    rows = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_count, orders=orders, bits=bits), "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class NgramModel:
    """labels; weights, a row for each; orders and bits of its n-grams. A LanguageIdentifier."""

    labels: tuple[str, ...]
    weights: np.ndarray
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS

    @classmethod
    def train(cls, df: DataFrame, text: str = "text", label: str = "lang", *, orders: tuple[int, ...] = ORDERS, bits: int = BITS, smoothing: float = 0.5) -> NgramModel:
        """All languages count as equally likely. The driver gets at most languages x 2^bits counts."""
        counts = bucket_counts(df, text, label, orders=orders, bits=bits)
        rows = counts.groupBy("label").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts")).orderBy("label").collect()
        weights = np.zeros((len(rows), 1 << bits))
        for i, r in enumerate(rows):
            weights[i, r.buckets] = r.counts
        weights += smoothing
        return cls(tuple(r.label for r in rows), np.log(weights / weights.sum(1, keepdims=True)), orders, bits)

    def scores(self, texts: Sequence[str | None], chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods, a row for each text, and the number of n-grams of each text."""
        total, n = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts), dtype=np.int64)
        by_bucket = self.weights.T
        points, ends = code_points([t.lower() if t else t for t in texts])
        for order in self.orders:
            b, text = buckets(points, ends, order, self.bits)
            n += np.bincount(text, minlength=len(texts))
            for low in range(0, len(b), chunk):
                own = text[low : low + chunk]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                total[own[first]] += np.add.reduceat(by_bucket[b[low : low + chunk]], first)
        return total, n

    def best(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and posterior of each text; `unknown` at 0 for texts without n-grams.

        An n-gram of each order covers a character, so the exponent is divided by the number of orders. Ties go to the first label.
        """
        if not self.labels:
            return ["unknown"] * len(texts), np.zeros(len(texts))
        total, n = self.scores(texts)
        at = total.argmax(1)
        least = (total - total.max(1, keepdims=True)) / len(self.orders)
        share = 1 / np.exp(least).sum(1)
        return [self.labels[i] if k else "unknown" for i, k in zip(at, n)], np.where(n > 0, share, 0.0)

    def predict(self, texts: Sequence[str]) -> list[tuple[str, float]]:
        labels, share = self.best(texts)
        return list(zip(labels, share.tolist()))


@dataclass(frozen=True)
class Classifier:
    """A model as a text model of the classification task."""

    model: NgramModel

    def run(self, texts: Sequence[str]) -> list[tuple]:
        return self.model.predict(texts)


def _score(batches: Iterator[pa.RecordBatch], *, model, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        arrays, names = list(batch.columns), list(batch.schema.names)
        for c in columns:
            texts, labels, share = batch.column(c).to_pylist(), [], []
            for own in _slices(texts):
                some, p = model.value.best(texts[own])
                labels += some
                share.append(p)
            arrays += [pa.array(labels, pa.string()), pa.array(np.concatenate(share) if share else np.zeros(0))]
            names += [f"{c}_label", f"{c}_score"]
        yield pa.RecordBatch.from_arrays(arrays, names)


def identify_by(df: DataFrame, columns: Sequence[str], model: NgramModel) -> DataFrame:
    """Adds <column>_label and <column>_score for each text column, an Arrow batch at a time. Null and empty texts are `unknown` at 0."""
    ship_package(df.sparkSession)
    schema = StructType(list(df.schema.fields))
    for c in columns:
        schema = schema.add(f"{c}_label", "string").add(f"{c}_score", "double")
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.mapInArrow(partial(_score, model=shared, columns=tuple(columns)), schema)


def held_out_accuracy(df: DataFrame, text: str = "text", label: str = "lang", *, folds: int = 5) -> pd.DataFrame:
    """Per label, rows of one fold (by a hash of the text, so copies stay together) and how many a model of the other folds gets right."""
    fold = F.pmod(F.xxhash64(text), F.lit(folds))
    model = NgramModel.train(df.filter(fold != 0), text, label)
    found = identify_by(df.filter((fold == 0) & F.col(label).isNotNull() & (F.length(text) > 0)).select(text, label), [text], model)
    return found.groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col(f"{text}_label") == F.col(label)).alias("right")).toPandas()
