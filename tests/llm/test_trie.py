import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lingmill.llm.running import running_sums
from lingmill.llm.trie import Louds, paths, prefix_trie, rebuilt, trie_query, turns_of

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def n_words(text):
    return len("".join(" " if ord(c) in (32, *range(9, 14)) else c for c in text).split(" ")) - "".join(" " if ord(c) in (32, *range(9, 14)) else c for c in text).split(" ").count("")


def brute(rows):
    """Nodes by the definition: sets of members of every prefix."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h]) + tuple(turns[h:])  # the remainder has the sign of c, as in SQL
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not kids[node]
        saved[node] += (len(members[node]) - 1) * n_words(node[-1][1]) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    ends = lambda node: ",".join(str(c) for c in sorted(members[node]) if made[c] == node)
    return sorted(((min(m), len(v), min(members[v[:-1]]) if v else None, len(m), len(kids[v]), leaves[v], saved[v], hashlib.sha256(ends(v).encode()).hexdigest()) for v, m in members.items()), key=str)


def conversations():
    r = random.Random(6)
    rows = []
    say = lambda: " ".join(r.choices(["a", "b\tc", "é", ""], k=r.randint(0, 3)))
    pool = [[(r.choice(["user", "assistant", None]), say() if r.random() < 0.9 else None) for _ in range(r.randint(1, 9))] for _ in range(12)]
    for c in range(200):
        turns = list(r.choice(pool))
        turns = turns[: r.randint(1, len(turns))] + [("user", say()) for _ in range(r.randint(0, 3))]
        rows += [(c, t if r.random() < 0.97 else None, role, text) for t, (role, text) in enumerate(turns)]
    rows = [x for x in rows if x[0] not in (40, 41, 60)]  # absent bases
    rows += [(c, t, "user", "same words here") for c in range(300, 400) for t in range(12)]  # a hot group
    rows += [(500, t, "user", f"long {t}") for t in range(2500)] + [(501, t, "user", f"long {t}") for t in range(2000)]
    rows += [(-7, 0, "user", "x"), (-7, 0, "user", "x"), (-7, 0, "system", "x"), (None, 0, "user", "x"), (1, 0, "user", "again")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("shard", [40, 200_000])
def test_equals_brute_force(spark, shard):
    rows = conversations()
    got = trie_query(table(spark, rows).repartition(5), shard=shard).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table(spark):
    assert trie_query(table(spark, [])).count() == 0


def test_turnless_conversations(spark):
    """A conversation shorter than its h with an absent base has no turn and ends at the root."""
    rows = [(c, 0, "user", "x") for c in range(21, 40)]
    got = trie_query(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    root = next(r for r in got if r.depth == 0)
    assert root.n_convs == 19 and root.ends_sha256 != hashlib.sha256(b"").hexdigest()


def test_running_sums_over_partitions(spark):
    r = random.Random(8)
    rows = [(k, i, r.randint(-5, 5)) for k, n in ((1, 3000), (2, 1), (3, 700), (9, 2)) for i in range(n)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k long, i long, v long").repartition(7)
    got = sorted(map(tuple, running_sums(df.orderBy("k", "i"), "k", ["v"]).select("k", "i", "v", "v_sum").collect()))
    total, want = defaultdict(int), []
    for k, i, v in rows:
        total[k] += v
        want.append((k, i, v, total[k]))
    assert got == want


def test_louds():
    r = np.random.default_rng(9)
    for n in (0, 1, 2, 50, 400):
        parent = np.array([r.integers(-1, i) if i else -1 for i in range(n)], dtype=np.int64)
        shuffle = r.permutation(n)
        moved = np.empty(n, dtype=np.int64)
        moved[shuffle] = np.where(parent < 0, -1, shuffle[parent]) if n else parent
        louds, order = Louds.of(moved, r.integers(0, 5, n))
        place = {int(x): i for i, x in enumerate(order)}
        assert sorted(place) == list(range(n)) and len(louds.bits) == 2 * n + 1
        assert [int(p) for p in louds.parent] == [place.get(int(moved[x]), -1) for x in order]
        for node in range(-1, n):
            assert list(louds.children(node)) == [i for i in range(n) if louds.parent[i] == node]
        values = r.integers(0, 100, n)
        want = values.copy()
        for i in reversed(range(n)):
            if louds.parent[i] >= 0:
                want[louds.parent[i]] += want[i]
        assert louds.rollup(values).tolist() == want.tolist()


def test_shards_can_be_walked(spark):
    """A conversation's turns lead down the bits and labels of its shard."""
    rows = [(c, t, "user", f"w{(c // 20) % 3} {t}") for c in range(0, 400, 20) for t in range(5)]
    nodes, shards = prefix_trie(paths(*rebuilt(turns_of(table(spark, rows)))))
    by_key = {n.key: n for n in nodes.collect()}
    seen = 0
    for s in shards.collect():
        louds = Louds(np.unpackbits(np.frombuffer(s.louds, np.uint8))[: s.bits].astype(bool), np.array(s.labels))
        assert len(s.nodes) == len(s.labels) == len(s.leaves)
        for i, key in enumerate(s.nodes):
            kids = [s.nodes[k] for k in louds.children(i)]
            assert all(by_key[k].parent == key for k in kids) and by_key[key].n_leaves == s.leaves[i]
            seen += 1
    assert seen == sum(n.n_convs > 1 and n.depth > 0 for n in by_key.values()) == 15
