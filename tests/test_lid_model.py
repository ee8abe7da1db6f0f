import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lingmill.operators.lid_model import BITS, MIX, MULTIPLIERS, ORDERS, NgramModel, bucket_counts, held_out_accuracy, identify_by
from lingmill.session import load

SF = "/root/testdata/sf0.01"


def brute_buckets(text):
    out = []
    for order in ORDERS:
        for i in range(len(text) - order + 1):
            h = order + sum((ord(text[i + k]) + 1) * MULTIPLIERS[k] for k in range(order))
            out.append((h * MIX % 2**32) >> (32 - BITS))
    return out


def rows():
    r = random.Random(3)
    say = lambda letters: " ".join("".join(r.choices(letters, k=r.randint(1, 7))) for _ in range(r.randint(0, 30)))
    kinds = {f"l{k:02}": [chr(97 + (7 * k + j * (k + 1)) % 26) for j in range(9)] + ["é" if k % 2 else "😀"] for k in range(70)}
    return [(lang, say(letters)) for lang, letters in kinds.items() for _ in range(6)] + [("l00", None), (None, "text"), ("l01", "")]


def test_counts_and_scores_equal_brute_force(spark):
    own = rows()
    df = spark.createDataFrame(own, "lang string, text string").repartition(3)
    want = Counter((lang, b) for lang, t in own if lang and t for b in brute_buckets(t.lower()))
    assert {(r.label, r.bucket): r.n for r in bucket_counts(df).collect()} == dict(want)
    model = NgramModel.train(df)
    assert list(model.labels) == sorted({lang for lang, t in own if lang and t})
    totals = {lang: sum(n for (x, _), n in want.items() if x == lang) for lang in model.labels}
    texts = [t for _, t in own if t][::17] + ["Été 😀", ""]
    got, n = model.scores(texts)
    for i, t in enumerate(texts):
        own_buckets = brute_buckets(t.lower())
        assert n[i] == len(own_buckets)
        for k, lang in enumerate(model.labels):
            expect = sum(math.log((want[lang, b] + 0.5) / (totals[lang] + 0.5 * 2**BITS)) for b in own_buckets)
            assert math.isclose(got[i, k], expect, rel_tol=1e-9, abs_tol=1e-9)


def test_posteriors(spark):
    model = NgramModel(("a", "b", "c"), np.log(np.random.default_rng(1).dirichlet([1.0] * 2**BITS, 3)))
    for t, (label, p) in zip(["some text", "x"], model.predict(["some text", "x"])):
        total = model.scores([t])[0][0] / len(ORDERS)
        e = np.exp(total - total.max())
        assert label == "abc"[int(total.argmax())] and math.isclose(p, (e / e.sum()).max())
    assert model.predict(["", "x" * 200_000])[0] == ("unknown", 0.0)
    assert NgramModel((), np.zeros((0, 2**BITS))).predict(["x"]) == [("unknown", 0.0)]


def test_batches_and_edges(spark):
    model = NgramModel.train(spark.createDataFrame([("x", "aaa aaa"), ("y", "bbb bbb")], "lang string, text string"))
    df = spark.createDataFrame([(1, "aa a", "bb"), (2, None, ""), (3, "b" * 700_000, "AAA")], "id long, text string, other string")
    out = {r.id: r for r in identify_by(df, ["text", "other"], model).collect()}
    assert (out[1].text_label, out[1].other_label, out[3].text_label, out[3].other_label) == ("x", "y", "y", "x")
    assert (out[2].text_label, out[2].text_score, out[2].other_label) == ("unknown", 0.0, "unknown")
    empty = df.limit(0)
    assert identify_by(empty, ["text"], model).count() == 0 and NgramModel.train(empty, "text", "other").labels == ()


def test_held_out_accuracy_over_documents(spark):
    found = held_out_accuracy(load(spark, SF, "documents").filter(F.length("text") >= 40))
    assert len(found) == 4 and found["n"].min() >= 15
    assert (found["right"] / found["n"]).min() >= 0.95, found
