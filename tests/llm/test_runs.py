import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from lingmill.llm.runs import Extensions, RangeMinimum, _numbers, periodic_runs, planted, runs_of, runs_query

SCHEMA = "doc_id long, text string, runs string"


def brute_runs(words):
    """By the definition: every stretch, its smallest period, and whether a neighbour extends it."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - start
            if length >= max(6, 4 * p):
                found.setdefault((start, length), p)
    return sorted((s, n_, p) for (s, n_), p in found.items())


def brute(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts():
    r = random.Random(5)
    out = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "a b " * 3 + "a", "a b " * 4, "x" * 100_000, "  a b c", "a b c " * 40 + "z " + "b c a " * 40]
    for _ in range(120):
        words = [r.choice("abcdé") for _ in range(r.randint(1, 60))]
        while r.random() < 0.8:
            at = r.randrange(len(words))
            unit = words[at : at + r.randint(1, 9)]
            words[at:at] = unit * r.randint(1, 7)
        out.append(r.choice([" ", "\n", " \t\r"]).join(words))
    return out


def test_minima_and_extensions():
    r = np.random.default_rng(1)
    for n in (1, 2, 15, 16, 17, 100, 1000):
        v = r.integers(0, 1000, n)
        low = r.integers(0, n, 300)
        high = low + 1 + (r.integers(0, n, 300) % (n - low))
        assert RangeMinimum(v)(low, high).tolist() == [int(v[a:b].min()) for a, b in zip(low, high)]
    for x in ([0], [0] * 50, [0, 1] * 30, r.integers(0, 2, 200), r.integers(0, 3, 77)):
        x = np.unique(np.array(x), return_inverse=True)[1]
        e, n = Extensions(x), len(x)
        for i in range(0, n + 1, 3):
            js = np.array([j for j in range(n + 1) if j != i])
            want = [next((t for t in range(n + 1) if i + t >= n or j + t >= n or x[i + t] != x[j + t])) for j in js]
            assert e(np.full(len(js), i), js).tolist() == want


def test_runs_equal_the_definition():
    for t in texts():
        words = (t or "").encode().split()
        assert [tuple(r) for r in runs_of(_numbers(words)).tolist()] == brute_runs(words)


def test_query_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts() * 3)] + [(None, "a " * 9), (5, "b " * 9), (5, "b " * 9), (-30, "c d " * 20)]
    out = runs_query(spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)).collect()
    assert any(r.n_runs > 1 for r in out) and any(planted(i, (t or "").encode().split()) != (t or "").encode().split() for i, t in rows if i is not None)
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, out), key=key) == sorted((brute(i, t) for i, t in rows), key=key)


def test_long_texts_and_empty_table(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(3000)}" for _ in range(60_000)]
    text = " ".join(base + base[:50] * 6 + ["same"] * 100_000)
    (row,) = periodic_runs(spark.createDataFrame([(1, text, None)], SCHEMA)).collect()
    found = {(x.length, x.period) for x in row.runs}
    assert (100_000, 1) in found and any(p == 50 and 300 <= n < 310 for n, p in found)
    assert len(row.collapsed.split()) < 60_100
    assert runs_query(spark.createDataFrame([], SCHEMA)).count() == 0
