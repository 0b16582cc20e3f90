"""Training-data queries against their SQL on another engine."""

import math
import os

import pytest

from barline.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def rows(df):
    names = sorted(df.columns)
    plain = df[names].astype(object)
    plain = plain.where(plain.notna(), None)
    return sorted((tuple(r) for r in plain.itertuples(index=False)), key=lambda r: [str(round(x, 3) if isinstance(x, float) else x) for x in r]), names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    (got, names), (want, other) = rows(queries.QUERIES[name](spark, DATA).toPandas()), rows(con.sql(queries.ORACLES[name]).df())
    assert names == other and len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)) for a, b in zip(g, w)), (g, w)
