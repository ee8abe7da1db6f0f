import random
import re

import numpy as np
import pytest

from lingmill.llm import minhash
from lingmill.llm.components import components, extended
from lingmill.llm.minhash import estimate, near_duplicates, registers, shingle_sets

SCHEMA = "doc_id long, text string, kept string, n_shingles int, digest string"


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Sizes and components; rows that share a doc_id share a component."""
    rows = [(i, brute_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(rows):
        for j, t in rows[:k]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in rows), key=str)


def fixture(copies=250, seed=1):
    """A base text with near copies of all degrees, so that many stand just below the threshold."""
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["É", "日本", "Don't"]
    base = r.choices(vocab, k=150)
    texts = []
    for _ in range(copies):
        own = list(base)
        for _ in range(r.randint(0, 14)):
            own[r.randrange(len(own))] = r.choice(vocab)
        texts.append(" ".join(own))
    texts += [" ".join(r.choices(vocab, k=r.randint(1, 200))) for _ in range(60)]
    texts += [None, "", " \t\n", "one two", "One  TWO", "one two three four five", "ONE two\nthree four five", "one two three four five six", " ".join(base) + "\xa0", " ".join(base * 40)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows + rows[:5] + [(None, texts[0]), (None, None), (rows[7][0], "a text of its own under a known id")]


def run(spark, rows):
    out = near_duplicates(spark.createDataFrame([(i, t, "x", 3, "y") for i, t in rows], SCHEMA)).collect()
    assert all(x.kept == (x.doc_id is None or x.doc_id == x.component_id) for x in out)
    return sorted(((x.doc_id, x.n_shingles, x.component_id) for x in out), key=str)


def test_equals_brute_force(spark):
    rows = fixture()
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, None)]) == [(3, 0, 3)]


def test_shingles_of_bytes_equal_words():
    texts = [t or "" for _, t in fixture(30)]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    assert [len(s) for s in shingle_sets(data, offsets)] == [len(brute_set(t)) for t in texts]


@pytest.mark.parametrize("both,only", [(300, 50), (300, 200), (50, 400)])
def test_estimate(both, only):
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 63, size=both + 2 * only, dtype=np.uint64)
    regs = registers([x[: both + only], np.concatenate([x[:both], x[both + only :]])])
    n = np.array([float(both + only)])
    assert abs(estimate(regs[:1], regs[1:], n, n)[0] - both / (both + 2 * only)) < 0.12


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (7, 8), (5, 5), (4, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (25, 26), (3, None)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 7, 8: 7, 7: 7} | {k: 20 for k in range(20, 27)}


def test_extended_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(240)]
    table = lambda some: spark.createDataFrame(some, "a long, b long").filter("a <> b").localCheckpoint()
    comps = None
    for at in range(0, 240, 60):
        comps = extended(comps, table(links[at : at + 60]))
    comps = extended(comps, table([]))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(comps) == rows(components(table(links)))


def test_a_round_contracts_its_own_links_only(spark, monkeypatch):
    """Before, each round of pivots contracted the links of all rounds before again."""
    seen = []

    def recorded(comps, links):
        seen.append({tuple(x) for x in links.select("a", "b").collect()})
        return extended(comps, links)

    monkeypatch.setattr(minhash, "extended", recorded)
    rows = fixture()
    assert run(spark, rows) == brute(rows)
    assert len(seen) > 1 and sum(map(len, seen)) == len(set().union(*seen))
