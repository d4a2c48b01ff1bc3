import os

import duckdb
import pandas as pd
import pytest

from plumbline.plans import catalog

SF = "/root/testdata/sf0.001"
catalog.queries()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(str([None if pd.isna(v) else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for v in r]) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, con, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(catalog.ORACLES[name]).df())
