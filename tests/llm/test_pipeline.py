import random
import sys

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, times int"


def words(i, n):
    r = random.Random(i)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def rows():
    out = [(i, words(i, 40 + i % 20), "en", f"s{i % 5}", 0, "k", 1) for i in range(300)]
    out += [(1000 + i, out[i][1], "en", "s1", 0, "k", 1) for i in range(30)]  # exact copies
    out += [(2000 + i, out[i][1] + " tail", "en", "s2", 0, "k", 1) for i in range(30)]  # near copies
    out += [(3000 + i, words(i + 5000, 30) + " idiot moron scum loser", "en", None, 0, "k", 1) for i in range(40)]  # toxic
    out += [(5, out[5][1], "en", "s0", 0, "k", 1), (None, None, None, None, None, None, None), (None, "a null id", "en", "s0", 0, "k", 1), (4000, None, "en", "s1", 0, "k", 1), (4001, "", "en", "s1", 0, "k", 1)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), DOCS).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(300)] + [(3000 + i, 1, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    ids = [r.doc_id for r in clean.select("doc_id").collect()]
    assert len(ids) == docs.count() - 40 and not any(3000 <= (i or 0) < 3040 for i in ids)
    clean = spark.createDataFrame(clean.collect(), docs.schema)
    deduped = stages["near_dedup"](spark, clean, folder)
    assert deduped.columns == docs.columns
    left = deduped.collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [*range(300), 4000, 4001] and len(left) == 304
    deduped = spark.createDataFrame(left, docs.schema)
    mixed = stages["mixing"](spark, deduped, folder)
    assert mixed.columns == docs.columns
    size = lambda rs: sum(len((r.text or "").split()) for r in rs)
    assert abs(size(mixed.collect()) - 1.5 * size(left)) <= 60 * 6
    packed = stages["packing"](spark, mixed, folder)
    assert packed.count() >= mixed.count()


def test_stages_keep_columns_of_any_name(spark, folder):
    names = ["of", "_of", "n", "row", "id", "size", "key", "cell", "target", "room", "epochs", "sample", "extra", "component_id", "__id", "__kept", "score", "low"]
    data = [(*r, *[f"{c}-{r[0]}" for c in names]) for r in rows()[:330]]
    docs = spark.createDataFrame(data, DOCS + ", " + ", ".join(f"`{c}` string" for c in names))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        made = out.collect()
        assert made and set(map(tuple, made)) <= set(data)


def test_repeated_rows_are_matched_one_by_one(spark, folder):
    docs = spark.createDataFrame([(1, "a b c", "en", "x", 0, "", 0)] * 3 + [(None, "d e", "en", "x", 0, "", 0)] * 2, DOCS)
    out = pipeline.mixing(spark, docs, folder).collect()
    taken = sum(len(r.text.split()) for r in out)
    assert abs(taken - 1.5 * 13) <= 3 and len(out) <= 10


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert pipeline.run(spark, folder).count() > 300
    d = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert pipeline.run(spark, d).count() == 0


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert "corpus_pipeline" in sys.modules
