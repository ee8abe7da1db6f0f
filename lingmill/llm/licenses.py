"""Licence scan by a positional rare-token index, in built-in expressions only.

Templates are licence notices and grants. The words of all templates are counted over the whole
corpus; each template is then indexed under its rarest (highest-IDF) words with their
positions. A file looks up which of its words stand in that index, turns each into the starts
it implies for templates by the word's postings, intersects the starts of different words, and verifies the
template's mandatory key phrase word by word where they agree. Postings and templates are constants of the plan, so the work
follows the hits, not the number of templates. A base phrase is looked up
under its rarest word alone and verified in full, so no place of it is missed.

Everything but the corpus count is local to a row; the count shuffles at most one
row per template word and task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places the contract counts, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str  # must be a run of words of text


TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("gnu-gpl", "this work is licensed under the gnu general public license version", "gnu general public license"),
    Template("gnu-lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    Template("gnu-agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    Template("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc0", "to the extent possible under law the author has waived all copyright", "waived all copyright"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying"),
    # whole grants and notices
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
        "with the software or the use or other dealings in the software",
        "without limitation the rights to use copy modify merge publish distribute sublicense",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions in binary form must reproduce the above copyright notice",
    ),
    Template(
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "may be used to endorse or promote products derived from this software",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "the author disclaims all warranties with regard to this software",
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "to alter it and redistribute it freely",
    ),
    Template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "you may not use this file except in compliance with the license",
    ),
    Template(
        "gnu-gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability "
        "or fitness for a particular purpose see the gnu general public license for more details",
        "under the terms of the gnu general public license as published by the free software foundation",
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "if a copy of the mpl was not distributed with this file",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        "anyone is free to copy modify publish use compile sell or distribute this software",
    ),
    Template(
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display "
        "distribute execute and transmit the software and to prepare derivative works of the software",
        "any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def vocabulary(templates: Sequence[Template], base: dict[str, str]) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()} | {w for p in base for w in p.split()})


def idf(docs: DataFrame, vocab: Sequence[str]) -> dict[str, float]:
    """IDF of each word over all documents. What comes to the driver is one row per template word."""
    present = F.array_intersect(words_of(text_of()), F.array(*map(F.lit, vocab)))
    rows = docs.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    n = {r["w"]: r["count"] for r in rows}
    total = n.get("", 0)
    return {w: math.log((total + 1) / (n.get(w, 0) + 1)) + 1 for w in vocab}


def _starts(word: str, at: int) -> Column:
    """The starts that the places of an index word imply for a template in which it is at `at`."""
    hits = F.filter("hits", lambda h: h["w"] == word)
    return F.transform(hits, lambda h: h["i"] - at)


def _verifier(words: str, phrase: Sequence[str], at: int = 0) -> Callable[[Column], Column]:
    """Whether phrase stands in words, `at` words after a start."""
    want = F.array(*map(F.lit, phrase))
    return lambda start: F.when(start + at >= 0, F.slice(words, start + at + 1, F.lit(len(phrase))) == want).otherwise(False)


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda s: F.struct(F.lit(label).alias("label"), s.alias("start")))


def _constant(value: object, kind: str) -> Column:
    """A value as one literal, whatever its size; it is read once, when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _template_data(templates: Sequence[Template], weight: dict[str, float]) -> Column:
    """Of each template by number: its label, its words with their shares of its IDF, its key phrase and where that stands."""
    made = []
    for t in templates:
        words, key = t.text.split(), t.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        total = sum(weight[w] for w in words)
        made.append({"label": t.label, "words": [{"w": w, "share": weight[w] / total} for w in words], "key": key, "at": at})
    return _constant(made, "array<struct<label:string,words:array<struct<w:string,share:double>>,key:array<string>,at:int>>")


def _postings(templates: Sequence[Template], anchors: dict[Template, list[str]]) -> Column:
    """Index word to its places (template, offset, which index word of the template)."""
    by: dict[str, list[dict]] = {}
    for n, t in enumerate(templates):
        for i, w in enumerate(t.text.split()):
            if w in anchors[t]:
                by.setdefault(w, []).append({"t": n, "offset": i, "a": anchors[t].index(w)})
    return _constant(by, "map<string,array<struct<t:int,offset:int,a:int>>>")


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, base: dict[str, str] = BASE, *, rare: int = 5, least_share: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    A base phrase scores 1; another template scores the share of its IDF found at the best
    place where its key phrase is verified and the share is least_share or more; without
    either the score is 0. places holds (label, start) of base phrases. Null and empty texts have no
    words, places or labels. Repeated rows stay, an empty table gives an empty one, and
    only doc_id and text are read.
    """
    weight = idf(docs, vocabulary(templates, base))
    by_rarity = lambda words: sorted(dict.fromkeys(words), key=lambda w: (-weight[w], words.index(w)))
    anchors = {p: by_rarity(p.split())[0] for p in base} | {t: by_rarity(t.text.split())[:rare] for t in templates}
    index = sorted({anchors[p] for p in base} | {w for t in templates for w in anchors[t]})

    hit = lambda w, i: F.when(w.isin(index), F.struct(w.alias("w"), i.alias("i")))
    rows = docs.select("doc_id", words_of(text_of()).alias("words"))
    rows = rows.select("doc_id", "words", F.filter(F.transform("words", hit), lambda h: h.isNotNull()).alias("hits"))

    nothing = F.array().cast("array<struct<t:int,start:int,a:int>>")
    base_places = []
    for p, label in base.items():
        phrase = p.split()
        starts = F.concat(*[_starts(anchors[p], at) for at, w in enumerate(phrase) if w == anchors[p]])
        base_places.append(_labelled(F.filter(starts, _verifier("words", phrase)), label))
    # the starts that hits imply, of any template; two index words of one agree on a start where they stand beside each other in order
    postings, data = _postings(templates, {t: anchors[t] for t in templates}), _template_data(templates, weight)
    implied = F.flatten(F.transform("hits", lambda h: F.coalesce(F.transform(F.try_element_at(postings, h["w"]), lambda e: F.struct(e["t"].alias("t"), (h["i"] - e["offset"]).alias("start"), e["a"].alias("a"))), nothing)))
    rows = rows.select("doc_id", "words", F.concat(*base_places).alias("places"), F.array_sort(F.array_distinct(implied)).alias("implied"))
    before = lambda i: F.get("implied", i - 1)
    agreed = F.filter("implied", lambda x, i: (i > 0) & F.coalesce((before(i)["t"] == x["t"]) & (before(i)["start"] == x["start"]), F.lit(False)))
    rows = rows.select("doc_id", "words", "places", F.array_distinct(F.transform(agreed, lambda x: F.struct(x["t"].alias("t"), x["start"].alias("start")))).alias("agreed"))

    def verified(x: Column) -> Column:
        key, at = F.get(data, x["t"])["key"], F.get(data, x["t"])["at"]
        return F.when(x["start"] + at >= 0, F.slice("words", x["start"] + at + 1, F.size(key)) == key).otherwise(False)

    def share(x: Column) -> Column:
        parts = F.transform(F.get(data, x["t"])["words"], lambda p, k: F.when(F.get("words", x["start"] + k) == p["w"], p["share"]).otherwise(F.lit(0.0)))
        return F.least(F.lit(1.0), F.aggregate(parts, F.lit(0.0), lambda a, p: a + p))

    found = F.transform(F.filter("agreed", verified), lambda x: F.struct(F.get(data, x["t"])["label"].alias("label"), share(x).alias("share")))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "places", F.filter(found, lambda f: f["share"] >= least_share).alias("found"))

    at = F.col("places")["start"]
    base_labels = F.col("places")["label"]
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("found")["share"]), F.lit(0.0)))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.col("found")["label"]))), ",").alias("labels"),
        score.cast("double").alias("score"),
        "places",
    )


def licenses_query(docs: DataFrame) -> DataFrame:
    """The contract's columns of `scan`, one row per row of docs: null and empty texts have no words, null first and last words, no
    labels and score 0; rows may repeat and a doc_id may be null; an empty table gives an empty one; other columns are not read."""
    return scan(docs).drop("places")
