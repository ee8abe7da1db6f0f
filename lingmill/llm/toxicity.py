"""Toxicity by weak supervision.

Voters are lexicons and patterns: a list of insults, shouting, and classes of words and word
starts that a labelled sample shows to be far likelier in toxic texts. A generative model of
their votes (expectation maximisation over a hidden label, with voters that agree beyond
what the label explains merged into one vote by their estimated correlation) gives each
sampled document a posterior label. A linear classifier on hashed, length-free features is
trained on those posteriors and scores every document.

What is fitted: at most `sample_rows` labelled ids and one text of each, none of them held out, chosen by a hash
of doc_id; everything it makes (voters, weights) has a fixed bound. What is scored: every
whole text. Labels, languages, sources and ids are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import cut, ship_package, text_of, trim

#: Insults that vote on their own, whatever the sample shows.
INSULTS = frozenset("idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns dumb imbecile filth vermin retard".split())

WORD = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6)
LEVELS = (2, 4)


def held_out(doc_id: Column) -> Column:
    """Rows of which nothing is learnt."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def of_word(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STARTS if len(word) >= n)]


def levels(count: int) -> Iterator[str]:
    """What a word start that so many different words of a text share adds to its name."""
    yield ""
    for n in LEVELS:
        if count >= n:
            yield f"#{n}"


def features(text: str) -> set[str]:
    """Words, and word starts with the number of different words that share them, of a whole text."""
    counts = Counter(f for w in set(WORD.findall(text.lower())) for f in of_word(w))
    return {f + x for f, n in counts.items() for x in levels(n)}


#: The pattern voter's name among the features; no word has it.
SHOUTING = "!shouting"


def shouting(text: str) -> bool:
    """A pattern voter: long runs of capitals or of exclamation marks."""
    return bool(re.search(r"!{3,}|\b[A-Z]{4,}(?:\s+[A-Z]{4,}){2,}", text))


class Model:
    """Feature weights of the linear classifier and its bias; scores texts with a memo by word."""

    def __init__(self, weights: dict[str, float], bias: float, memo_words: int = 100_000):
        self.weights, self.bias, self.memo_words = weights, bias, memo_words
        self.bases = {f.partition("#")[0] for f in weights}
        self.memo: dict[str, tuple[str, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def hits(self, word: str) -> tuple[str, ...]:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= self.memo_words:
                self.memo.clear()
            found = self.memo[word] = tuple(f for f in of_word(word) if f in self.bases)
        return found

    def score(self, text: str) -> float:
        counts = Counter(f for w in set(WORD.findall(text.lower())) for f in self.hits(w))
        z = self.bias + math.fsum(self.weights.get(f + x, 0.0) for f, n in counts.items() for x in levels(n))
        if SHOUTING in self.weights and shouting(text):
            z += self.weights[SHOUTING]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, feature) for a sample's rows, in bounded batches."""
    kinds = [pa.int64(), pa.int32(), pa.string()]
    for batch in batches:
        ids, ys, fs = [], [], []
        for i, y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = features(t.as_py())
            if shouting(t.as_py()):
                found.add(SHOUTING)
            ids += [i] * len(found)
            ys += [y] * len(found)
            fs += found
            if len(fs) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip((ids, ys, fs), kinds)], ["doc_id", "toxic", "feature"])
                ids, ys, fs = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip((ids, ys, fs), kinds)], ["doc_id", "toxic", "feature"])


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 50, merge_at: float = 0.3, alone: int = 0, most_silent: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of a hidden label from votes (documents x voters, 1 fires, 0 abstains).

    Each voter has a rate at which it fires given either label, `start` (2 x voters) at first.
    Voters' correlation beyond what the label explains under these rates is estimated once;
    a voter's weight is 1 / (1 + sum of those above merge_at), so that copies of one voter count
    as about one; the last `alone` voters count fully.
    Many voters' silence together tells at most most_silent (in log odds): lexicons of other
    languages are silent on every document. Expectation maximisation then fits rates and posteriors.
    Returns posteriors, rates (2 x voters), weights.
    """
    n, v = votes.shape
    rate = np.clip(start, 1e-4, 1 - 1e-4)
    mean = votes.mean(0)
    left = votes - mean
    spread = np.sqrt(np.maximum(1e-9, mean * (1 - mean)))
    explained = prior * (1 - prior) * np.outer(rate[1] - rate[0], rate[1] - rate[0])
    beyond = np.maximum(0, left.T @ left / max(1, n) - explained) / np.outer(spread, spread)
    np.fill_diagonal(beyond, 0)
    beyond[v - alone :], beyond[:, v - alone :] = 0, 0
    weight = 1 / (1 + np.where(beyond > merge_at, np.minimum(beyond, 1), 0).sum(1))
    post = np.full(n, prior)
    for r in range(rounds):
        fired, silent = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
        lexicon, given = np.arange(v) < v - alone, np.arange(v) >= v - alone
        quiet = (1 - votes) @ (weight * silent * lexicon)
        z = np.log(prior / (1 - prior)) + votes @ (weight * fired) + np.clip(quiet, -most_silent, most_silent) + (1 - votes) @ (silent * given)
        new = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        done = r > 5 and np.abs(new - post).max() < 1e-6
        post = new
        for y, p in ((1, post), (0, 1 - post)):
            rate[y] = np.clip((p @ votes + 0.5) / (p.sum() + 1), 1e-4, 1 - 1e-4)
        if done:
            break
    return post, rate, weight


def linear(rows: np.ndarray, cols: np.ndarray, n: int, width: int, target: np.ndarray, l2: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on presence features, by accelerated gradient steps."""
    w, b = np.zeros(width), float(np.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3)))
    vw, vb = w.copy(), b
    per_row = np.maximum(1, np.bincount(rows, minlength=n)).max()
    step = 4.0 / (1 + min(per_row, 64))
    scale = 1 / np.maximum(1, np.sqrt(np.bincount(cols, minlength=width)))
    for k in range(rounds):
        z = np.bincount(rows, vw[cols], minlength=n) + vb
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        nw = vw - step * (np.bincount(cols, g[rows], minlength=width) * scale + l2 * vw)
        nb = vb - step * g.mean()
        m = k / (k + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 20_000, voters: int = 400, least_odds: float = 1.5) -> Model:
    """Fit on at most sample_rows labelled ids that are not held out, and one text of each.

    Only counts by feature of the sample, its voters' votes and the model reach the driver;
    all are bounded by sample_rows and voters. Without usable labels the insults alone decide.
    """
    ship_package(docs.sparkSession)
    own = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample_rows)
    # one text an id, the first by a hash, however often the id stands in docs
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(cut(chosen)), "doc_id").groupBy("doc_id", "toxic")
    sample = texts.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = cut(sample.mapInArrow(_feature_rows, "doc_id bigint, toxic int, feature string"))
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    fallback = Model({w: 6.0 for w in INSULTS}, -4.0)
    if not pos or not neg:
        return fallback
    count = rows.groupBy("feature").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("n") - F.col("p") + 0.5) / (neg + 1.0))
    # a pure coincidence among that many features must stay unlikely: a likelihood ratio beyond 2 ln(features)
    share = pos / (pos + neg)
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    ratio = 2 * (term(F.col("p"), F.col("n") * share) + term(F.col("n") - F.col("p"), F.col("n") * (1 - share)))
    count = cut(count.withColumn("odds", odds).withColumn("ratio", ratio))
    least = 2 * math.log(max(2, count.count()))
    good = count.filter((F.col("ratio") >= least) & (F.col("odds") >= least_odds) | F.col("feature").isin(*INSULTS, SHOUTING))
    mined = cut(good.orderBy(F.desc("ratio"), "feature").limit(voters))
    names = [r.feature for r in mined.select("feature").collect()]
    if not names:
        return fallback
    at = {f: i for i, f in enumerate(sorted(names))}
    fired = rows.join(F.broadcast(mined.select("feature")), "feature").select("doc_id", "feature").toPandas()
    ids = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).toPandas().sort_values("doc_id").reset_index(drop=True)
    r = np.searchsorted(ids.doc_id.to_numpy(), fired.doc_id.to_numpy())
    c = fired.feature.map(at).to_numpy(dtype=np.int64)
    # the given label is one more voter, of an accuracy to be estimated like the others'
    y = ids.toxic.to_numpy(dtype=float)
    votes = np.zeros((len(ids), len(at) + 1), dtype=np.float32)
    votes[r, c] = 1
    votes[:, -1] = y
    start = np.vstack([((y == k) @ votes + 0.5) / ((y == k).sum() + 1) for k in (0, 1)])
    start[:, -1] = 0.02, 0.95
    post, _, _ = label_model(votes, min(0.5, max(0.01, pos / (pos + neg))), start, alone=1)
    # documents where no voter fires tell the classifier what is clean
    w, b = linear(r, c, len(ids), len(at), post)
    return Model({f: float(w[i]) for f, i in at.items()}, float(b))


def scorer(model: Model):
    """A column function text -> score; null and empty texts get the bias's score."""

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        trim()
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return lambda text: score(text)


def toxicity_query(docs: DataFrame, labels: DataFrame, *, at: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without words; texts of any length are scored whole; repeated rows stay; a null doc_id
    is not held out; labels of null or unknown ids teach nothing. An empty table gives an empty one. Other columns are not read."""
    score = scorer(fit(docs, labels))
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score(text_of()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= at).cast("int"))
