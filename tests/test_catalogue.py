import glob
import os

import duckdb
import pandas as pd
import pytest

from tideline.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    return int(v) if isinstance(v, float) and v.is_integer() else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, name):
    query, sql = QUERIES[name]
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = query(spark, SF).toPandas(), c.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(repr([plain(v) for v in r]) for r in d[cols].astype(object).values.tolist())
    assert rows(got) == rows(want)
