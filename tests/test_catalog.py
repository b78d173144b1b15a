"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tabulon.plans import cases, catalog  # noqa: F401 (cases registers more queries in the catalog)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLE:
        assert len(got)
        return
    want = db.sql(catalog.ORACLE[name]).df()
    by = sorted(want.columns)
    assert sorted(got.columns) == by
    tidy = lambda x: x[by].sort_values(by, key=lambda c: c.astype(str)).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)


def test_products_beyond_64_bits_are_summed(spark, db, tmp_path):
    rows = [(1_024_819, "A"), (1_024_820, "A"), (9_000_000_000, "A"), (9_223_372_036_854_775_807, "N"), (9_223_372_036_854_775_806, "N"), (-5, "R"), (None, "R")]
    spark.createDataFrame(rows, "l_orderkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.QUERIES["agg_02_exact_int_sum"](spark, str(tmp_path)).collect()
    sql = catalog.ORACLE["agg_02_exact_int_sum"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.sql(sql).fetchall())
