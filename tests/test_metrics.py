"""Metric kernels against plain Python."""

import random
import time
from collections import Counter

import pyarrow as pa
import pytest

from lingmill.operators import metrics
from lingmill.operators.metrics import clipped_matches, word_edits, word_error_rate

WORDS = pa.list_(pa.string())


def test_clipped_matches():
    r = random.Random(1)
    hyps, refs = ([r.choices(abc, k=r.randint(0, 12)) for _ in range(300)] for abc in ("abcd", "abcde"))
    out = clipped_matches(pa.array(hyps, WORDS).slice(7), pa.array(refs, WORDS).slice(7), 4)
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for n, (matched, total) in enumerate(out, 1):
        for k, (h, x) in enumerate(zip(hyps[7:], refs[7:])):
            assert matched[k] == sum((grams(h, n) & grams(x, n)).values()) and total[k] == max(0, len(h) - n + 1)
    assert clipped_matches(pa.array([[]], WORDS), pa.array([[]], WORDS), 2)[1][0].tolist() == [0]


def test_word_error_rate(spark):
    r = random.Random(2)
    rows = [(k % 3, " ".join(r.choices(["a", "b", "é", "日本", "😀", "x1"], k=r.randint(0, 15))), " ".join(r.choices(["a", "b", "é", "😀"], k=r.randint(0, 15)))) for k in range(200)]
    rows += [(0, None, "a b"), (1, "a  b", None), (2, "", "")]
    out = {x.k: x.wer for x in word_error_rate(spark.createDataFrame(rows, "k int, labels string, preds string"), ["k"]).collect()}
    for k, wer in out.items():
        own = [((a or "").split(), (b or "").split()) for j, a, b in rows if j == k]
        assert abs(wer - 100 * sum(word_edits(a, b) for a, b in own) / sum(len(a) for a, _ in own)) < 1e-5


def test_edits_equal_the_plain_table(spark):
    r = random.Random(7)
    say = lambda n: [r.choice(["a", "b", "c", "é", "dd"]) for _ in range(n)]
    pairs = [(say(r.randint(0, 12)), say(r.randint(0, 12))) for _ in range(300)]
    pairs += [(say(n), say(m)) for n in (1, 63, 64, 65, 128, 200) for m in (0, 1, 64, 130)] + [(["x"] * 70, ["x"] * 64), ([], []), (say(5), say(1100))]
    base = say(90)
    pairs += [(base, base), (base, base[1:]), (base[:64], base[2:64] + ["z"])]
    want = [metrics.word_edits(a, b) for a, b in pairs]
    kind = pa.list_(pa.string())
    for cells in (1 << 22, 300):
        assert metrics.batch_edits(pa.array([a for a, _ in pairs], kind), pa.array([b for _, b in pairs], kind), cells).tolist() == want
    assert [metrics.long_edits(a, b) for a, b in pairs] == want
    assert metrics.batch_edits(pa.array([], kind), pa.array([], kind)).tolist() == []


def test_long_texts_take_words_not_cells():
    r = random.Random(8)
    a = [r.randrange(2000) for _ in range(20_000)]
    b = [w for w in a if r.random() > 0.01]
    began = time.perf_counter()
    assert metrics.long_edits(a, b) == len(a) - len(b)
    assert time.perf_counter() - began < 5


def test_wer_of_whole_tables_equals_brute_force(spark):
    """The registered query against a plain table of edits over every row."""
    from lingmill.plans.registry import QUERIES

    d = "/root/testdata/sf0.001"
    turns = {(x.conv_id, x.turn): x for x in spark.read.parquet(f"{d}/conversations.parquet").collect()}
    edits, words = Counter(), Counter()
    for (c, t), x in turns.items():
        if (c, t + 1) in turns:
            ref, hyp = (x.text or "").split(), (turns[c, t + 1].text or "").split()
            edits[x.role] += metrics.word_edits(ref, hyp)
            words[x.role] += len(ref)
    got = {x.role: x.wer for x in QUERIES["wer"](spark, d).collect()}
    assert got == {k: pytest.approx(100 * edits[k] / words[k], abs=1e-6) for k in words} and len(got) >= 2
