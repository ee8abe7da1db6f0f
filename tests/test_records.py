"""Quoted CSV by splits against Spark's reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from lingmill.sources import readers
from lingmill.sources.records import INSIDE, START, after_line, csv_records, split_csv


@pytest.fixture
def splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}

    def of(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield of
    for k, v in before.items():
        spark.conf.set(k, v)


def whole(spark, path, columns, sep=",", header=True):
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, header=header, sep=sep, multiLine=True, quote='"', escape='"', enforceSchema=True)


TEXT = 'en,"fr\nname",de\n"a, b","c\nd",x\n\n"q ""x""","",\n5" disk,"l1\r\nl2\n\nl4","é"\n"many\n\n\n,lines ""\n","\n","end"\n,,\n'


def test_equal_at_every_cut(spark, tmp_path, splits):
    path = tmp_path / "x.csv"
    path.write_bytes(TEXT.encode())
    columns = ["en", "fr", "de"]
    want = [tuple(r) for r in whole(spark, str(path), columns).collect()]
    assert len(want) == 5
    for size in (1, 2, 3, 5, 8, 13, 21, 34, 55, len(TEXT) + 1):
        splits(size)
        rows, bad = split_csv(spark, str(path), columns=columns)
        assert sorted(map(str, rows.collect())) == sorted(map(str, whole_rows(columns, want))), size
        assert bad.count() == 0


def whole_rows(columns, rows):
    from pyspark.sql import Row

    return [Row(*columns)(*r) for r in rows]


def random_csv(seed, n, sep, end):
    r = random.Random(seed)
    bits = ["a", "é", " ", end, sep, '""', "word", end + end]

    def field():
        if r.random() < 0.5:
            return '"' + "".join(r.choices(bits, k=r.randint(0, 12))) + '"'
        return "".join(r.choices(["a", "b c", "é", "'", "x"], k=r.randint(1, 6)))

    return "".join(sep.join(field() for _ in range(3)) + r.choice([end, end, end + end]) for _ in range(n))


@pytest.mark.parametrize("seed, sep, end", [(1, ",", "\n"), (2, "\t", "\n"), (3, ",", "\r\n")])
def test_random_files(spark, tmp_path, splits, seed, sep, end):
    """Spark's reader takes a file's first line end for all of them, so a file has one kind here."""
    path = tmp_path / "r.csv"
    text = random_csv(seed, 250, sep, end)
    path.write_bytes(text.encode())
    columns = ["a", "b", "c"]
    want = sorted(map(str, whole(spark, str(path), columns, sep, header=False).collect()))
    for size in (200, 1000, len(text)):
        splits(size)
        rows, _ = split_csv(spark, str(path), sep=sep, header=False, columns=columns)
        assert sorted(map(str, rows.collect())) == want, size
    splits(1000)
    records = csv_records(spark, str(path), sep=sep)
    assert records.select("start").distinct().count() > 3  # several splits made records


def test_order_and_several_files(spark, tmp_path, splits):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("x,y\n" + "".join(f'{i},"{name}\n{i}"\n' for i in range(200)))
    splits(300)
    rows = csv_records(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv")).orderBy("path", "start", "n").collect()
    assert [r.record for r in rows] == [x for name in ("a.csv", "b.csv") for x in ("x,y", *[f'{i},"{name}\n{i}"' for i in range(200)])]
    both = readers.by_extension(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert both.columns == ["x", "y"] and both.count() == 400 and both.filter(F.col("y").contains("\n")).count() == 400


def test_states_of_lines():
    assert after_line("a,b", START) == START and after_line("a,b", INSIDE) == INSIDE
    assert after_line('a,"b', START) == INSIDE and after_line('b",c', INSIDE) == START
    assert after_line('b"",c', INSIDE) == INSIDE and after_line('b","c', INSIDE) == INSIDE
    assert after_line('"a"",b",5" x,""', START) == START and after_line('5" x', START) == START
    assert after_line('a\t"b', START, "\t") == INSIDE and after_line('a,"b', START, "\t") == START


def test_open_quote_and_empty_files(spark, tmp_path):
    (tmp_path / "o.csv").write_text('a,b\n1,"open\nto the end\n')
    assert [r.record for r in csv_records(spark, str(tmp_path / "o.csv")).orderBy("n").collect()] == ["a,b", '1,"open\nto the end']
    (tmp_path / "e.csv").write_text("")
    assert csv_records(spark, str(tmp_path / "e.csv")).count() == 0
    with pytest.raises(ValueError):
        split_csv(spark, str(tmp_path / "e.csv"))


def test_marked_blocks_at_every_cut(spark, tmp_path, splits):
    text = "preamble en: x\nQ: one\nA: eins\nA line with Q: inside\n\nQ: two\nmore\nA: zwei\nQ: no second\nQ:three\nA:drei\r\nend\n"
    path = tmp_path / "b.txt"
    path.write_bytes(text.encode())
    want = sorted(map(tuple, spark.read.text(str(path), wholetext=True).select(F.explode(readers.marked_blocks(F.col("value"), "Q", "A")).alias("p")).select("p.*").collect()))
    assert len(want) == 3
    for size in (1, 4, 9, 17, 40, 70, len(text) + 1):
        splits(size)
        assert sorted(map(tuple, readers.marked_block_files(spark, str(path), first="Q", second="A").collect())) == want, size


def test_many_blocks_over_splits(spark, tmp_path, splits):
    path = tmp_path / "m.txt"
    path.write_text("".join(f"Q: {i}\n{'x' * (i % 90)}\nA: -{i}\n" for i in range(3000)))
    splits(5000)
    rows = readers.marked_block_files(spark, str(path), first="Q", second="A").collect()
    assert {(r.source_text.split()[0], r.target_text) for r in rows} == {(str(i), f"-{i}") for i in range(3000)} and len(rows) == 3000
