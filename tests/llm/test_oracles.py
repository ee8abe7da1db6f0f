"""Training-data queries against their SQL in DuckDB, at two sizes."""

import duckdb
import pytest

from lingmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name, sf):
    d = f"/root/testdata/{sf}"
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    want = c.execute(ORACLES[name])
    columns = [x[0] for x in want.description]
    got = QUERIES[name](spark, d)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
