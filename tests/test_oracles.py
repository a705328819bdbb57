"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans import ORACLES, QUERIES


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or (not isinstance(v, (list, np.ndarray)) and pd.isna(v)):
            return "null"
        if isinstance(v, (list, np.ndarray)):
            return str([plain(x) for x in v])
        if isinstance(v, (float, np.floating)):
            return f"{v:.6f}".rstrip("0").rstrip(".")
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
