"""Each query with oracle SQL against DuckDB on the smallest tables."""

import os
from pathlib import Path

import pytest

from quillgraph.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def rows(frame, columns):
    import pandas as pd

    def text(x):
        if x is None or (not isinstance(x, list) and pd.isna(x)):
            return "null"
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    return sorted(tuple(map(text, r)) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
