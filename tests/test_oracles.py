"""Every registered market query against its SQL on another engine."""

import math
import os

import pytest

from barline.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def other():
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in ("events", "orders"):
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def rows(df):
    names = sorted(df.columns)

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return float(x) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(plain(x) for x in r) for r in df[names].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_same_rows(spark, other, name):
    got, want = rows(queries.queries()[name](spark, DATA).toPandas()), rows(other.sql(queries.oracles()[name]).df())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) < 2e-6) for a, b in zip(g, w)), (g, w)
