"""The queries of this subpackage that have SQL, on the smallest tables."""

import os

import duckdb
import pytest

from marlstone.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF).select(*got.columns)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(got.fetchall(), key=repr)
