"""Language identification: a model contract, a rule-based model, and its distributed run."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship_package
from .curate import lid_resolve
from .mapping import made_once


class LanguageIdentifier(Protocol):
    def predict(self, texts: Sequence[str]) -> list[tuple[str, float]]:
        """(label, score) of each text."""


class StopWordIdentifier:
    """Scores languages by their share of a text's words that are common words of theirs."""

    #: Common words of four languages.
    WORDS = {
        "eng_Latn": "the of and to in is that for it with as was on are be at by this from or have an not",
        "fra_Latn": "le la les de des et un une est que dans pour qui sur au pas ce se il elle du en",
        "deu_Latn": "der die das und in zu den von mit ist des auf für nicht ein eine dem sich es im auch",
        "spa_Latn": "el la los las de y que en un una es por con para se del al como lo no su más",
    }

    def __init__(self, words: dict[str, str] | None = None):
        self.sets = {k: frozenset(v.split()) for k, v in (words or self.WORDS).items()}

    def predict(self, texts: Sequence[str]) -> list[tuple[str, float]]:
        out = []
        for text in texts:
            words = re.findall(r"\w+", text.lower())
            shares = {k: sum(w in s for w in words) for k, s in self.sets.items()}
            best = max(sorted(shares), key=shares.get)
            out.append((best, shares[best] / sum(shares.values())) if words and shares[best] else ("unknown", 0.0))
        return out


def identify(df: DataFrame, columns: Sequence[str], make: Callable[[], LanguageIdentifier] = StopWordIdentifier) -> DataFrame:
    """Adds <column>_label and <column>_score for each text column, in one pass through Python.

    make() is called once per worker process. A null text is `unknown` at 0.
    """
    ship_package(df.sparkSession)
    schema = StructType(list(df.schema.fields))  # add() would change the frame's own
    for c in columns:
        schema = schema.add(f"{c}_label", "string").add(f"{c}_score", "float")

    pickled = cloudpickle.dumps(make)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = made_once(pickled)
        for pdf in frames:
            for c in columns:
                some = pdf[c].notna()
                found = dict(zip(pdf.index[some], model.predict(pdf.loc[some, c].tolist())))
                pdf[f"{c}_label"] = [found.get(i, ("unknown", 0.0))[0] for i in pdf.index]
                pdf[f"{c}_score"] = pd.Series([found.get(i, ("unknown", 0.0))[1] for i in pdf.index], index=pdf.index, dtype="float32")
            yield pdf

    return df.mapInPandas(run, schema)


def lid_score(bitext: DataFrame, make: Callable[[], LanguageIdentifier] = StopWordIdentifier) -> DataFrame:
    """Scores the sides of a bitext that have no score yet. Texts of scored sides don't reach Python."""
    wanted = {f"_{s}": F.when(F.col(f"{s}_lid").isNull(), F.col(f"{s}_text")) for s in ("source", "target")}
    scored = identify(bitext.withColumns(wanted), list(wanted), make)
    predict = {s: (F.regexp_replace(F.col(f"_{s}_label"), "^__label__", ""), F.col(f"_{s}_score")) for s in ("source", "target")}
    return lid_resolve(scored, predict).drop(*[f"_{s}{x}" for s in ("source", "target") for x in ("", "_label", "_score")])
