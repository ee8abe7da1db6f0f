"""Every registered query of the engine against its SQL in DuckDB, and a few plans."""

import math

import duckdb
import pytest

from lingmill.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: "NULL" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert normal(rows, df.columns) == normal(want.fetchall(), columns)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0


def test_filter_and_columns_reach_the_scan(spark, capsys):
    from pyspark.sql import functions as F

    from lingmill.operators.curate import length_totals
    from lingmill.session import load

    df = length_totals(load(spark, SF, "documents").filter(F.col("lang") == "en"), "lang", "text")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(lang,en)" in plan and "ReadSchema: struct<text:string,lang:string>" in plan
