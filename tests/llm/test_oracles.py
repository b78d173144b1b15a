"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tabulon.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = db.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()[list(want.columns)]
    by = list(want.columns)
    tidy = lambda x: x.sort_values(by, key=lambda c: c.astype(str)).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)
