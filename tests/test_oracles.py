"""Every core query against its SQL, on the smallest driver tables."""

import os

import duckdb
import numpy as np
import pytest

from cairn import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")


def frame(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind in "iuf":
            df[c] = df[c].astype(float).round(7)
        else:
            df[c] = df[c].map(lambda x: "~" if x is None or x != x else str(x))
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    a, b = frame(queries.QUERIES[name](spark, DATA).toPandas()), frame(duck.execute(queries.ORACLES[name]).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a:
        if a[c].dtype == float and b[c].dtype == float:
            np.testing.assert_allclose(a[c], b[c], rtol=1e-7, atol=1e-7, equal_nan=True)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist()
