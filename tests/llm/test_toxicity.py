import random
import zlib

import numpy as np

from lingmill.llm.toxicity import Model, fit, label_model, toxicity_query

DOCS = "doc_id long, text string, lang string, score string, predicted int"
LABELS = "doc_id long, quality int, toxic int"
SECRET = ["blorptan", "blorpfin", "blorpzu", "grumlek", "idiot", "scum"]


def data(n=1500, noise=0.03):
    r = random.Random(8)
    vocab = ["".join(r.choices(["ka", "lo", "mi", "ne", "ru", "ta", "be"], k=r.randint(1, 4))) for _ in range(2000)]
    docs, labels = [], []
    for i in range(n):
        words, toxic = r.choices(vocab, k=r.randint(20, 120)), r.random() < 0.12
        if toxic:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(SECRET).capitalize())
        docs.append((i, " ".join(words), "xx", "x", 1))
        if i % 5:
            labels.append((i, 1, int(toxic) if r.random() > noise else 1 - int(toxic)))
    return docs, labels, {i for i, t, *_ in docs if any(s in t.lower() for s in SECRET)}


def test_held_out_accuracy(spark):
    docs, labels, truth = data()
    out = toxicity_query(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in out if r.held_out]
    found = {r.doc_id for r in held if r.predicted}
    real = {r.doc_id for r in held} & truth
    assert len(found & real) >= 0.9 * len(real) and len(found - real) <= 0.05 * len(real) + 1


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = data(400)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    d = spark.createDataFrame(docs, DOCS)
    a, b = (fit(d, spark.createDataFrame(x, LABELS)) for x in (labels, flipped))
    assert a.weights == b.weights and a.bias == b.bias


def test_edges(spark):
    docs, labels, _ = data(300)
    labels = spark.createDataFrame([*labels, (3, None, None), (None, 1, 1)], LABELS)
    rows = [(1, None, None, None, None), (1, "", "", "", 0), (None, "you idiot", "", "", 0), (2, "scum " * 50000, "", "", 0), (2, "scum " * 50000, "", "", 0)]
    out = toxicity_query(spark.createDataFrame([*docs, *rows], DOCS), labels).collect()
    assert len(out) == 305 and all(r.score is not None for r in out)
    empty = spark.createDataFrame([], DOCS)
    assert toxicity_query(empty, labels).count() == 0
    none = toxicity_query(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)).collect()
    assert {r.predicted for r in none if r.doc_id == 2} == {1} and {r.predicted for r in none if r.doc_id == 1} == {0}


def test_label_model_tells_good_voters_from_copies():
    r = np.random.default_rng(0)
    y = r.random(3000) < 0.2
    good = [(y & (r.random(3000) < 0.8)) | (~y & (r.random(3000) < 0.02)) for _ in range(4)]
    noisy = r.random(3000) < 0.3
    votes = np.array([*good, noisy, noisy, noisy], dtype=np.float32).T
    given = y ^ (r.random(3000) < 0.05)
    start = np.vstack([votes[given == k].mean(0) for k in (0, 1)])
    post, rate, weight = label_model(votes, 0.2, start)
    assert ((post > 0.5) == y).mean() > 0.96
    assert weight[4:].max() < 0.5 < weight[:4].min()


def test_model_scores_whole_texts():
    m = Model({"bad": 9.0, "xyza*#2": 5.0}, -4.0)
    assert m.score("word " * 100000 + "bad") > 0.9 and m.score("") < 0.1
    assert m.score("xyzab xyzab") < 0.1 < 0.5 < m.score("xyzab xyzac")


def test_a_hot_id_is_one_sample(spark, monkeypatch):
    """Whatever the rows of an id, the sample has one text of it, and what is collected doesn't grow."""
    from pyspark.sql import functions as F

    from lingmill.llm import toxicity

    docs, labels, _ = data(300)
    hot = next(i for i, _, t in labels if t and zlib.crc32(str(i).encode()) % 4 != 2)
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    many = d.unionByName(spark.range(3000).select(F.lit(hot).alias("doc_id"), F.concat(F.lit("you idiot scum "), F.col("id")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("score", "string"), ("predicted", "int"))]))
    held = toxicity._feature_rows
    count = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in held(batches):
            count.add(len(set(b.column(0).to_pylist())))
            yield b

    monkeypatch.setattr(toxicity, "_feature_rows", counted)
    fit(many, y)
    assert count.value <= 2 * len(labels)
