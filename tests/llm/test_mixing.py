import math
import random
from collections import defaultdict

import pytest
import xxhash

from lingmill.llm.mixing import mix, mixed_documents, mixing_query

SCHEMA = "doc_id long, text string, source string, target int, taken string"


def water(sizes, weights, share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        each = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        over = [s for s in open_ if each[s] > cap * sizes[s]]
        if not over:
            return {**out, **each}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= set(over)
    return out


def rows(n=3000):
    r = random.Random(4)
    names = ["b", "a", "é", "z", None, "hot", "hot", "hot", "tiny"]
    out = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(names)) for i in range(n)]
    return out + [(1, None, "a"), (2, "", None), (None, "x y", "a"), (5, "same row", "b"), (5, "same row", "b"), (-1, "one word", "single")]


def frame(spark, data):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in data], SCHEMA)


def test_targets_and_near_sums(spark):
    data = rows()
    out = mix(frame(spark, data), cell_rows=64).collect()
    assert len(out) == len(data)
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    want = water(sizes, (5, 2, 1))
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        assert r.taken >= r.epochs * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60


def test_reruns_agree_whatever_the_partitions(spark):
    data = rows(800)
    one = sorted(map(str, mixing_query(frame(spark, data)).collect()))
    random.Random(9).shuffle(data)
    assert one == sorted(map(str, mixing_query(frame(spark, data).repartition(7)).collect()))


def test_better_documents_come_first(spark):
    data = [(i, "word " * 20, "s") for i in range(500)] + [(i, "12 34 " * 10, "s") for i in range(500, 1000)] + [(i, "word " * 20, "t") for i in range(1000, 3000)]
    out = [r for r in mix(frame(spark, data), weights=(1, 20), cap=2.0).collect() if r.source == "s"]
    good, bad = (sum(r.taken for r in out if (r.doc_id < 500) == g) for g in (True, False))
    assert good > 1.3 * bad


def test_empty_table_and_empty_texts(spark):
    assert mixing_query(frame(spark, [])).count() == 0
    out = mixing_query(frame(spark, [(1, "", "a"), (2, None, "b")])).collect()
    assert [(r.size, r.taken, r.target) for r in out] == [(0, 0, 0.0)] * 2


def chained(*values):
    """The hash that draws: strings one after the other, then a 32-bit seed."""
    h = 42
    for v in values[:-1]:
        h = xxhash.xxh64_intdigest(v.encode(), seed=h)
    m = (1 << 64) - 1
    rotl = lambda x, r: ((x << r) | (x >> 64 - r)) & m
    h = (h + 0x27D4EB2F165667C5 + 4) & m
    h ^= values[-1] * 0x9E3779B185EBCA87 & m
    h = (rotl(h, 23) * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & m
    for shift, by in ((33, 0xC2B2AE3D27D4EB4F), (29, 0x165667B19E3779F9)):
        h = ((h ^ h >> shift) * by) & m
    return h ^ h >> 32


def brute_sample(data, seed=7):
    """(doc_id, text, source) -> words taken, by sorting each source's keys and offering every document."""
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    want, out = water(sizes, (5, 2, 1)), defaultdict(list)
    for s in sizes:
        keyed = []
        for i, t, s2 in data:
            if s2 == s:
                t = t or ""
                letters = sum(c.isalpha() for c in t)
                q = max(0.25, round(letters / max(1, len(t)), 6))
                u = (chained("null" if i is None else str(i), t, seed) % (1 << 52) + 0.5) / (1 << 52)
                keyed.append((-math.log(u) / q, i is None, i or 0, len(t.split()), t))
        epochs = int(want[s] // sizes[s]) if sizes[s] else 0
        total, room, ended = 0, want[s] - epochs * sizes[s], False
        for key, _, i, n, t in sorted(keyed):
            fits = n <= room
            ended |= not fits
            out[s].append((key, i, n, epochs, fits, ended))
            room -= n if fits else 0
    return out


@pytest.mark.parametrize("cell_rows", [8, 64, 100_000])
def test_sample_equals_brute_force(spark, cell_rows):
    data = rows(900)
    want = brute_sample(data)
    got = defaultdict(lambda: defaultdict(list))
    for r in mix(frame(spark, data), cell_rows=cell_rows).collect():
        got[r.source][r.doc_id or 0].append((r.size, r.times))
    for s, every in want.items():
        by_id = defaultdict(list)
        for _, i, n, epochs, fits, ended in every:
            by_id[i].append((n, epochs, fits, ended))
        for i, own in by_id.items():
            have = sorted(got[s][i])
            assert [n for n, _ in have] == sorted(n for n, *_ in own)
            for (n, times), (_, epochs, fits, ended) in zip(have, sorted(own)):
                # behind the place where the first document doesn't fit, small ones are offered only inside the interval
                assert times == epochs + fits or ended and times == epochs


CLASHES = ["id", "size", "key", "row", "cell", "target", "room", "epochs", "sample", "extra", "times", "n", "low", "high", "of", "source_size", "spread", "number", "takes_t", "rows_t", "col", "__no", "a.b", "kept", "Rows"]


def test_columns_of_any_name_stay(spark):
    data = [(i, " ".join(["w"] * (1 + i % 30)), "ab"[i % 2], *[f"{c}-{i}" for c in CLASHES]) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    out = mixed_documents(docs, cell_rows=16)
    assert out.columns == docs.columns
    known = {d[0]: d for d in data}
    made = out.collect()
    assert made and all(tuple(r) == known[r.doc_id] for r in made)


def test_equal_rows_and_null_ids(spark):
    data = [(None, "same words here", "a")] * 3000 + [(None, f"text {i} of a null id", "b") for i in range(2000)] + [(9, "x" * 1_500_000 + " y", "c")]
    out = mix(frame(spark, data), cell_rows=50).collect()
    taken = defaultdict(int)
    for r in out:
        taken[r.source] += r.taken
    goal = {r.source: r.target for r in out}
    assert len(out) == len(data) and all(abs(taken[s] - goal[s]) <= 5 for s in goal)
    assert len({r.times for r in out if r.source == "b"}) == 2
