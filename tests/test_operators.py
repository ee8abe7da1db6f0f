"""Edge frames and properties of the engine's operators."""

import io
import math
import os
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingmill import registry, schemas
from lingmill.functions import sequences, text, vectors
from lingmill.operators import batching, curate, lid, metrics, noise, pairing, retrieval, sinks, stats
from lingmill.sources import readers

BITEXT = "id long, source_text string, target_text string, source_nllb_code string, target_nllb_code string, source_lid float, target_lid float"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def pairs(spark, rows):
    """(source, target) or (source, target, codes...) rows."""
    full = [(i, r[0], r[1], *(r[2:4] if len(r) > 2 else ("eng_Latn", "fra_Latn")), *(r[4:6] if len(r) > 4 else (None, None))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, BITEXT)


FACTORS = [("eng_Latn", 1.0), ("fra_Latn", 1.0)]


@pytest.mark.parametrize("raw,key", [("Émile's  café—№ 12!\tÀ_b\x01x 😀é", "émiles café à_bx é"), ("a\tb", "ab"), ("   ", ""), ("123", ""), ("!?", ""), ("A  b", "a b")])
def test_dedup_key(spark, raw, key):
    assert one(spark, text.dedup_key(F.lit(raw))) == key


def test_text_functions(spark):
    assert one(spark, text.strip(F.lit("  a b "))) == "a b"
    assert one(spark, text.n_chars(F.lit("😀é"))) == 2
    assert one(spark, text.code(F.lit("eng"), F.lit(None))) is None
    assert one(spark, text.canonical_pair(F.lit("b"), F.lit("a"))) == "a-b"
    assert one(spark, registry.remap(F.lit("xx"), {"en": "eng"})) == "xx"


def test_registry(spark):
    assert len(registry.LANGUAGES) == len(set(registry.LANGUAGES)) == 202 and len(registry.HIGH_RESOURCE) == 25
    assert set(registry.HIGH_RESOURCE) <= set(registry.LANGUAGES)
    assert registry.languages(spark).filter("high_resource").count() == 25
    assert registry.parse_pairs("a-b, c-d") == [("a", "b"), ("c", "d")]
    for bad in ("a", "a-", "a-b-c"):
        with pytest.raises(ValueError):
            registry.parse_pairs(bad)
    assert registry.all_pairs(spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "nllb_code string")).count() == 3


def test_schemas(spark):
    df = spark.createDataFrame([], schemas.INGESTED)
    assert schemas.assert_schema(df, schemas.LENGTH_FILTERED) is df
    with pytest.raises(ValueError, match="source_lid"):
        schemas.assert_schema(df.drop("source_lid"), schemas.INGESTED)
    dotted = schemas.to_dotted(df)
    assert "source.nllb_code" in dotted.columns and schemas.from_dotted(dotted).columns == df.columns


def kept(spark, rows, factors=FACTORS, **options):
    f = spark.createDataFrame(factors, "nllb_code string, correction_ratio double")
    return sorted(r.id for r in curate.length_filter(pairs(spark, rows), f, **options).collect())


def test_length_filter_boundaries(spark):
    assert kept(spark, [("a" * 60, "b" * 15), ("a" * 61, "b" * 15), ("a" * 14, "b" * 15), ("", ""), (None, "b" * 20)]) == [0]
    assert kept(spark, [("a" * 20, "b" * 90, "xxx_Latn", "eng_Latn"), ("a" * 20, "b" * 30, None, "eng_Latn")], max_ratio=4.0) == [1]
    assert kept(spark, [("a" * 20, "b" * 90, None, "eng_Latn")]) == [0]  # a null language has no corrected length


def test_length_filter_is_symmetric(spark):
    rows = [("a" * n, "b" * m) for n in (10, 15, 40, 70) for m in (15, 33, 160)]
    assert kept(spark, rows) == kept(spark, [(b, a) for a, b in rows])


def test_correction_factors_need_the_pivot(spark):
    df = spark.createDataFrame([("fra_Latn", "abc")], "nllb_code string, sentence string")
    with pytest.raises(Exception, match="no texts in eng_Latn"):
        curate.correction_factors(df).collect()


def test_lid_null_patterns_and_boundaries(spark):
    rows = [("x", "y", "eng_Latn", "fra_Latn", s, t) for s, t in ((None, None), (None, 0.9), (0.9, None), (0.9, 0.9))]
    out = curate.lid_resolve(pairs(spark, rows), {"source": (F.lit("deu_Latn"), F.lit(0.7)), "target": (F.lit(None).cast("string"), F.lit(None).cast("double"))}).orderBy("id").collect()
    assert [(r.source_lid_predicted, round(r.source_lid, 3), r.target_lid_predicted, round(r.target_lid, 3)) for r in out] == [("deu_Latn", 0.7, "unknown", 0.0), ("deu_Latn", 0.7, "fra_Latn", 0.9), ("eng_Latn", 0.9, "unknown", 0.0), ("eng_Latn", 0.9, "fra_Latn", 0.9)]
    edge = pairs(spark, [("", "", "eng_Latn", "ltz_Latn", s, t) for s, t in ((0.5, 0.9), (0.96, 0.6), (0.95, 0.6), (0.96, 0.5))])
    assert [r.id for r in curate.lid_high_resource(curate.lid_confident(edge)).collect()] == [1]


def test_lid_scoring(spark):
    df = pairs(spark, [("the cat and the dog", "le chat et le chien"), (None, "???"), ("der Hund", "x", "eng_Latn", "fra_Latn", 0.9, 0.8)])
    out = {r.id: r for r in lid.lid_score(df).collect()}
    assert (out[0].source_lid_predicted, out[0].target_lid_predicted) == ("eng_Latn", "fra_Latn")
    assert (out[1].source_lid_predicted, out[1].source_lid, out[1].target_lid_predicted) == ("unknown", 0.0, "unknown")
    assert out[2].source_lid_predicted == "eng_Latn" and out[0].asDict().keys() == {*df.columns, "source_lid_predicted", "target_lid_predicted"}


def test_two_pass_dedup(spark):
    rows = [("A", "x"), ("A", "y"), ("B", "y"), ("b!", "z"), ("1", "p"), ("2", "q"), (None, "r"), (None, "s")]
    df = pairs(spark, rows)
    ids = lambda d, **o: sorted(r.id for r in curate.dedup(df, d, **o).collect())
    assert ids("source") == [0, 2, 4, 6] and ids("target") == [0, 1, 3, 4, 5, 6, 7] and ids("both") == [0, 2, 4, 6]
    assert ids("source", keep_empty_keys=True) == [0, 2, 4, 5, 6]
    again = curate.dedup(curate.dedup(df, "both"), "both")
    assert again.count() == 4
    with pytest.raises(ValueError):
        curate.dedup(df, "sideways")


def test_shards_and_sinks(spark, tmp_path):
    assert curate.rows_per_shard(0, 5) == 1 and curate.rows_per_shard(10, 3) == 4 and curate.rows_per_shard(7, 1) == 7
    df = spark.range(1000).selectExpr("id", "id % 3 as k")
    out = str(tmp_path / "a")
    assert sinks.write_shards(df, out, shards=4) and not sinks.write_shards(df, out, shards=4)
    counts = spark.read.parquet(out).groupBy(F.input_file_name()).count().collect()
    assert 4 <= len(counts) <= 8 and max(r["count"] for r in counts) <= 250
    sinks.write_partitioned(df, str(tmp_path / "b"), "k")
    assert {"k=0", "k=1", "k=2"} <= set(os.listdir(tmp_path / "b")) and spark.read.parquet(str(tmp_path / "b")).count() == 1000
    sinks.write_csv(spark.createDataFrame([('a "q"', "l1\nl2")], "x string, y string"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True, escape='"').first().y == "l1\nl2"
    sinks.write_as(df, str(tmp_path / "d"), "json")
    with pytest.raises(ValueError):
        sinks.write_as(df, str(tmp_path / "e"), "xlsx")
    seen, o = sinks.counted(df.filter("k = 1"), "ones")
    sinks.write_shuffled(seen, str(tmp_path / "f"), "id")
    assert o.get["rows"] == 333
    assert sinks.memo(df, str(tmp_path / "g")).count() == sinks.memo(spark.range(0), str(tmp_path / "g")).count() == 1000


def test_describe(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("a", None), ("b", None)], "nllb_code string, value double")
    a, b = stats.describe(df).orderBy("nllb_code").collect()
    assert (a["count"], a.null_count, a.total_count, a.mean, a.p25, a.p50, a.p75, a["max"]) == (4, 1, 5, 4.0, 1.0, 2.0, 3.0, 10.0)
    assert b["count"] == 0 and b.mean is None
    assert stats.describe(df, method="approx").filter("nllb_code = 'a'").first().p50 == 2.0
    assert stats.unknown(df.union(spark.createDataFrame([(None, 1.0)], df.schema))).count() == 7


def test_mined_transform_optional_columns(spark):
    raw = spark.createDataFrame([(1, ("a ", "b")), (2, (" ", "c")), (3, ("d", None)), (4, ("e", "f"))], "n int, translation struct<en:string,fr:string>")
    out = pairing.mined_transform(raw, ("en", "eng_Latn"), ("fr", "fra_Latn"), order=["n"], first_id=10)
    assert schemas.assert_schema(out, schemas.INGESTED)
    assert [(r.id, r.source_text, r.source_url, r.laser_score) for r in out.orderBy("id").collect()] == [("allenai_eng_Latn-fra_Latn_10", "a", "", None), ("allenai_eng_Latn-fra_Latn_13", "e", "", None)]


def emb(spark, rows):
    return spark.createDataFrame(rows, "lang string, id long, emb array<float>")


def test_xsim_ties_sizes_and_alignment(spark):
    e, f = [1.0, 0.0], [0.0, 1.0]
    out = retrieval.xsim(emb(spark, [("a", 0, e), ("b", 0, e), ("b", 1, e), ("b", 2, f)])).collect()
    assert {(r.src, r.tgt): (r.err, r.n) for r in out} == {("a", "b"): (0, 1), ("b", "a"): (2, 3)}
    three = [("a", i, [float(i == k) for k in range(3)]) for i in range(3)] + [("b", i, [float(i == k) for k in range(3)]) for i in range(2)]
    assert {(r.src, r.tgt): r.err for r in retrieval.xsim(emb(spark, three)).collect()}["a", "b"] == 1
    shifted = emb(spark, [("a", 5, e), ("a", 6, f), ("b", 6, f), ("b", 7, e)])
    assert sum(r.err for r in retrieval.xsim(shifted, align="id").collect()) == 2 and sum(r.err for r in retrieval.xsim(shifted).collect()) == 4
    with pytest.raises(ValueError):
        retrieval.xsim(shifted, margin="none")


def test_block_and_sql_neighbours_agree(spark):
    x = np.random.default_rng(0).standard_normal((90, 6))
    df = emb(spark, [("abc"[i % 3], i // 3, [float(v) for v in row]) for i, row in enumerate(x)] + [("a", 99, [0.0] * 6)])
    q = retrieval.positions(df)
    for search in (retrieval.nearest, retrieval.sql_nearest):
        rows = search(q, q, retrieval.different(), 3).select("src", "tgt", "i", "j", "rank").collect()
        got = sorted(map(tuple, rows))
        assert search is retrieval.nearest or got == first
        first = got
    small = retrieval.nearest(q, q, retrieval.different(), 3, block=7).select("src", "tgt", "i", "j", "rank")
    assert sorted(map(tuple, small.collect())) == first
    for margin in ("ratio", "distance"):
        a, b = (sorted(map(tuple, retrieval.xsim(df, margin=margin, k=50, search=s).collect())) for s in (retrieval.nearest, retrieval.sql_nearest))
        assert a == b
    scaled = df.withColumn("emb", F.transform("emb", lambda v: v * 3))
    assert sorted(map(tuple, retrieval.xsim(scaled, margin="ratio").collect())) == sorted(map(tuple, retrieval.xsim(df, margin="ratio").collect()))


def test_hard_negatives_come_last(spark):
    df = emb(spark, [("a", -2, [1.0]), ("a", -1, [1.0]), ("a", 4, [1.0]), ("a", 0, [1.0])])
    assert [r.id for r in retrieval.positions(df).orderBy("pos").collect()] == [0, 4, -1, -2]


def test_vectors(spark):
    z = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.l2_normalise(z)) == [0.0, 0.0] and one(spark, vectors.cosine(z, z)) is None
    t, m = F.array(F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(3.0), F.lit(2.0)), F.array(F.lit(9.0), F.lit(9.0))), F.array(F.lit(1), F.lit(1), F.lit(0))
    assert [one(spark, vectors.pool(t, m, h)) for h in ("mean", "max", "cls", "last")] == [[2.0, 3.5], [3.0, 5.0], [1.0, 5.0], [9.0, 9.0]]
    with pytest.raises(ValueError):
        vectors.pool(t, m, "median")


def test_sequences(spark):
    ids = F.array(*map(F.lit, [5, 6, 7]))
    assert one(spark, sequences.encode(ids, F.lit(1), 2, 4)) == [1, 5, 6, 2]
    assert one(spark, sequences.pad(ids, F.lit(2), 0)) == [5, 6] and one(spark, sequences.pad(ids, F.lit(5), -100)) == [5, 6, 7, -100, -100]
    assert one(spark, sequences.attention(ids, F.lit(5))) == [1, 1, 1, 0, 0]
    assert [sequences.mask_name(n) for n in ("input_ids", "target_ids")] == ["attention_mask", "target_attention_mask"]
    assert one(spark, sequences.rotate(F.array(*map(F.lit, [0, 1, 2, 3, 9])), F.lit(1))) == [0, 2, 3, 1, 9]
    assert [one(spark, sequences.bucket(F.lit(n), [10, 20])) for n in (10, 11, 21)] == [0, 1, 2]


def test_batching(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([10, 20, 5, 20, 99, 7, 100, 3])], "id long, length int")
    out = batching.dynamic_batches(df, [10, 20], 40).collect()
    assert {r.id: (r.bucket, r.batch) for r in out} == {0: (0, 0), 2: (0, 0), 5: (0, 0), 7: (0, 0), 1: (1, 0), 3: (1, 0), 4: (2, 0), 6: (2, 1)}
    assert batching.dynamic_batches(df, [10, 20], 30, drop_last=True).filter("bucket = 0").count() == 3
    assert batching.caps([10, 20], 40, 3) == [3, 2, 1]
    b = batching.lognormal_bounds(4, 100.0)
    assert b == sorted(b) and b[-1] == 100.0 and batching.check_bounds(b) == b
    for bad in ([-1, 2], [2, 1], [1, 1]):
        with pytest.raises(ValueError):
            batching.check_bounds(bad)
    sort = batching.buffer_sort(df, "id", 4, F.col("length")).orderBy("buffer", "rank").collect()
    assert [r.id for r in sort] == [1, 3, 0, 2, 6, 4, 5, 7]
    random = batching.batch_order(batching.dynamic_batches(df, [10, 20], 40), "random", epoch=1)
    assert sorted(r.position for r in random.collect()) == [0, 1, 2, 3]
    ranks = [sorted(r.slot for r in batching.rank_shard(spark.range(5).withColumnRenamed("id", "p"), "p", 3, k).collect()) for k in range(3)]
    assert ranks == [[0, 3], [1, 4], [2, 5]]


def test_expand_pairs(spark):
    df = spark.createDataFrame([(1, [1, 2], [3])], "id int, source_ids array<int>, target_ids array<int>")
    a, b = batching.expand_pairs(df, F.lit(False)).orderBy("side").collect()
    assert (a.input_ids, a.labels, a.mse, b.input_ids, b.labels) == ([1, 2], [3], 1, [3], [1, 2])
    a, b = batching.expand_pairs(df, F.lit(True)).orderBy("side").collect()
    assert a.input_ids == a.labels == [1, 2] and b.labels == [3] and b.mse == 0


def test_noise_properties(spark):
    ids = [1, *[x for k in range(10) for x in (20 + k, 12, 4)], 2]
    n = noise.Noise(permute=1.0, rotate=1.0, insert=0.2, mask=0.3, random=0.5)
    rows = lambda k=50: noise.Rows.of([ids] * k, list(range(k)))
    for step in (noise.permute, noise.rotate):
        out = step(rows(), n).lists()
        assert all(sorted(x) == sorted(ids) and (x[0], x[-1]) == (1, 2) for x in out) and len({tuple(x) for x in out}) > 5
    for cfg in (noise.Noise(random=0.0), noise.Noise(random=0.0, span_rate=3.0)):
        for x in noise.mask(rows(), cfg).lists():
            assert x.count(3) == math.ceil(0.3 * 30) and (x[0], x[-1]) == (1, 2)
    assert all(len(x) == 32 + math.ceil(0.2 * 32) and (x[0], x[-1]) == (1, 2) for x in noise.insert(rows(), n).lists())
    assert noise.add_noise(ids, 7, noise.TRAINING) == noise.add_noise(ids, 7, noise.TRAINING) != noise.add_noise(ids, 8, noise.TRAINING)
    assert noise.add_noise(ids, 7, noise.TRAINING, 1) != noise.add_noise(ids, 7, noise.TRAINING)
    assert noise.add_noise([1, 2], 7, n) == [1, 2] and noise.add_noise([], 7, n) == []
    for bad in ({"mask": 1.5}, {"span_rate": 0.0}):
        with pytest.raises(ValueError):
            noise.Noise(**bad)
    df = spark.createDataFrame([(1, ids), (2, [1, 2]), (3, None)], "id int, ids array<int>")
    out = {r.id: r.x for r in df.select("id", noise.masked_by_rank(F.col("ids"), F.col("id"), 0.3, 3).alias("x")).collect()}
    assert out[1].count(3) == 9 and out[2] == [1, 2] and out[3] is None
    out = {r.id: r.x for r in df.select("id", noise.noised(F.col("ids"), F.col("id"), n, most=10).alias("x")).collect()}
    assert out == {1: noise.add_noise(ids, 1, n), 2: [1, 2], 3: None}


def plain_noise(ids, key, n):
    """The steps one row and one token at a time."""
    draw = lambda kind, place: int(noise.draws(np.array([key]), kind, place)[0])
    ids = list(ids)
    token = lambda kind, place: n.first_random + draw(kind, place) % (n.vocabulary - n.first_random)
    if n.permute and len(ids) > 2:
        parts = [[]]
        for x in ids[1:-1]:
            parts[-1].append(x)
            if x == n.stop_id:
                parts.append([])
        parts = [p for p in parts if p]
        if len(parts) > 1:
            chosen = sorted(range(len(parts)), key=lambda p: (draw(noise.PERMUTE, p), p))[: math.ceil(n.permute * len(parts))]
            moved = list(parts)
            for slot, p in zip(sorted(chosen), chosen):
                moved[slot] = parts[p]
            ids = [ids[0], *[x for p in moved for x in p], ids[-1]]
    if n.mask and len(ids) > 2:
        size = len(ids) - 2
        count = math.ceil(n.mask * size)
        at = sorted(range(1, size + 1), key=lambda i: (draw(noise.MASK, i), i))[:count]
        for i in at:
            ids[i] = token(noise.MASK_TOKEN, i) if draw(noise.RANDOM, i) < n.random * noise.P else n.mask_id
    if n.insert and len(ids) > 2:
        count = math.ceil(n.insert * len(ids))
        places = sorted((1 + draw(noise.INSERT, j) % (len(ids) - 1), j) for j in range(count))
        new = [(at, token(noise.INSERT_TOKEN, r) if r < math.ceil(n.random * count) else n.mask_id) for r, (at, _) in enumerate(places)]
        for at, x in reversed(new):
            ids.insert(at, x)
    if n.rotate and len(ids) > 2 and draw(noise.ROTATE, 0) < n.rotate * noise.P:
        k = draw(noise.SHIFT, 0) % (len(ids) - 2)
        ids = [ids[0], *ids[1 + k : -1], *ids[1 : 1 + k], ids[-1]]
    return ids


def test_noise_equals_one_token_at_a_time():
    r = np.random.default_rng(2)
    lists = [r.choice([4, 7, 8, 50], size=k).tolist() for k in (0, 1, 2, 3, 4, 5, 9, 30, 200)]
    for n in (noise.TRAINING, noise.Noise(mask=0.4, random=0.5, insert=0.3, permute=0.6, rotate=0.7), noise.Noise(mask=0, rotate=1.0), noise.Noise(mask=1.0, random=1.0, rotate=0)):
        keys = list(range(100, 100 + len(lists)))
        assert noise.noised_rows(noise.Rows.of(lists, keys), n).lists() == [plain_noise(x, k, n) for x, k in zip(lists, keys)]


def test_metrics(spark):
    df = spark.createDataFrame([(1, "g", "a b c d e", "a b c d e"), (2, "g", "x", "a b"), (3, "h", "a b c q", "a b c d"), (4, "e", "", ""), (5, "n", None, "a")], "id int, k string, preds string, labels string")
    out = {r.k: r.bleu for r in metrics.corpus_bleu(df, ["k"]).collect()}
    assert 0 < out["g"] < 100 and 0 < out["h"] < 100 and out["e"] == out["n"] == 0.0
    # three of four words, two of three pairs, one of two triples, none of one: smoothed to one half
    assert abs(out["h"] - 100 * (3 / 4 * 2 / 3 * 1 / 2 * 1 / 2) ** 0.25) < 1e-4
    w = {r.k: r.wer for r in metrics.word_error_rate(df, ["k"]).collect()}
    assert w == {"g": round(200 / 7, 6), "h": 25.0, "e": None, "n": 100.0}
    assert metrics.word_edits("a b c".split(), "a x c d".split()) == 2
    assert one(spark, metrics.smoothed_cross_entropy(F.array(F.lit(0.0), F.lit(0.0)), F.lit(1))) == pytest.approx(math.log(2))
    assert one(spark, metrics.smoothed_cross_entropy(F.array(F.lit(0.0)), F.lit(-100))) is None
    assert metrics.accumulation_steps(25000, 100, 8) == 32 and metrics.sort_buffer(4, 5, 6) == 120


def write(path, data):
    with open(path, "w", encoding="utf-8") as f:
        f.write(data)
    return str(path)


def test_line_aligned_readers(spark, tmp_path):
    a, b, c = write(tmp_path / "a.en", "one\ntwo\nthree\n"), write(tmp_path / "a.fr", "un\ndeux\ntrois"), write(tmp_path / "b.fr", "un\ndeux\n")
    rows = readers.text_pair(spark, a, b, "eng_Latn", "fra_Latn").orderBy("line").collect()
    assert [(r.source_text, r.target_text) for r in rows] == [("one", "un"), ("two", "deux"), ("three", "trois")]
    with pytest.raises(Exception, match="different numbers of lines"):
        readers.text_pair(spark, a, c, "x", "y").collect()
    assert [r.value for r in readers.lines(spark, c, a).orderBy("line").collect()] == ["un", "deux", "one", "two", "three"]
    assert [(r.id, r.sentence) for r in readers.negatives(spark, c, "eng_Latn").orderBy(F.desc("id")).collect()] == [(-1, "un"), (-2, "deux")]


def test_tabular_readers(spark, tmp_path):
    p = write(tmp_path / "x.csv", 'en,fr\n" a, b ","c\nd"\n"q ""x""", y\n')
    assert [tuple(r) for r in readers.quoted_csv(spark, p).collect()] == [("a, b", "c\nd"), ('q "x"', "y")]
    p = write(tmp_path / "x.tsv", "a\tb\t\nc\td\t\n")
    assert [tuple(r) for r in readers.quoted_csv(spark, p, sep="\t", header=False).collect()] == [("a", "b"), ("c", "d")]
    assert readers.by_extension(spark, str(tmp_path / "x.csv")).columns == ["en", "fr"]
    with pytest.raises(ValueError):
        readers.by_extension(spark, "a.csv", "b.json")
    with pytest.raises(ValueError):
        readers.by_extension(spark, "a.doc")
    with pytest.raises(KeyError):
        readers.catalog(spark, {}, "n", "c", "s")


def test_tmx_and_archives(spark, tmp_path):
    tmx = write(tmp_path / "m.tmx", '<tmx><body><tu><tuv xml:lang="en"><seg>Hi</seg></tuv><tuv xml:lang="fr"><seg>Salut</seg></tuv></tu><tu><tuv xml:lang="en"><seg>Bye</seg></tuv></tu></body></tmx>')
    assert sorted(map(tuple, readers.tmx(spark, tmx, "en", "fr").collect()), key=str) == [("Bye", None), ("Hi", "Salut")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.txt", "l1\nl2\n")
    with tarfile.open(tmp_path / "z.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("b.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"l3"))
    for name, want in (("z.zip", [("d/a.txt", 0, "l1"), ("d/a.txt", 1, "l2")]), ("z.tar.gz", [("b.txt", 0, "l3")])):
        assert [(r.name, r.line, r.value) for r in readers.members(spark, str(tmp_path / name)).orderBy("line").collect()] == want


def test_line_expressions(spark):
    bars = lambda s: [tuple(x) for x in one(spark, readers.bar_lines(F.lit(s)))]
    assert bars("a  b|c  d") == [("a", "c"), ("b", "d")] and bars("a  b|c") == [("a b", "c")] and bars("a") == [("a", "")]
    blocks = one(spark, readers.marked_blocks(F.lit("gn: abcde\nf\nes: uno\ndos\ngn: x\nes: y"), "gn", "es"))
    assert [tuple(b) for b in blocks] == [("abcde f", "uno dos"), ("x", "y")]
    before, after = readers.tab_split(F.lit("a\tb\tc"))
    assert (one(spark, before), one(spark, after)) == ("a", "b\tc")
    s, t = readers.pair_of_path(F.lit("/data/eng_Latn-fra_Latn/part.parquet"))
    assert (one(spark, s), one(spark, t)) == ("eng_Latn", "fra_Latn")


def test_streaming(spark, tmp_path):
    from lingmill.streaming import curation as st

    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("A b!", "2024-01-01 00:00:00", 1.0), ("a  b", "2024-01-01 00:10:00", 3.0), ("c", "2024-01-01 02:00:00", 5.0)], "t string, ts string, v double").selectExpr("t", "cast(ts as timestamp_ntz) as ts", "v").write.parquet(src)
    schema = spark.read.parquet(src).schema
    st.curate_files(spark, src, schema, lambda df: df.filter("v > 1"), sink, str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.parquet(sink).count() == 2
    for name, make, want in (("dd", lambda e: st.dedup_stream(e, "t", "ts"), 2), ("tw", lambda e: st.tumbling_stats(e, "ts", "v", "t"), None)):
        q = make(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert want is None or spark.table(name).count() == want


def test_row_numbers(spark):
    from lingmill.operators.ordering import number_rows, number_within

    df = spark.range(5000).selectExpr("id", "id % 7 as k", "(id * 7919) % 5003 as v", "if(id % 7 = 3, null, id % 7) as n").repartition(9)
    out = number_rows(df, ["v"], "at", start=10).orderBy("v").collect()
    assert [r["at"] for r in out] == list(range(10, 5010))
    for key in ("k", "n"):
        groups = {}
        for r in number_within(df, [key], [F.desc("v")], "at").collect():
            groups.setdefault(r[key], []).append((r["at"], -r.v))
        assert len(groups) == 7
        for rows in groups.values():
            rows.sort()
            assert [a for a, _ in rows] == list(range(len(rows))) and [v for _, v in rows] == sorted(v for _, v in rows)
    assert number_rows(df.filter("false"), ["v"], "at").count() == 0
