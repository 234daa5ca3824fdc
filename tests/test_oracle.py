"""Every query with SQL agrees with it on the smallest test tables."""

import os

import duckdb
import pandas as pd
import pytest

from weft.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in os.listdir(SF):
        if file.endswith(".parquet"):
            con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [*catalog.ORACLE_SQL])
def test_query(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-9, rtol=0)
