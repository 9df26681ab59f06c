import glob
import os

import duckdb
import pytest

from poregrid.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, data_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    have = queries.queries()[name](spark, data_dir)
    want = con.sql(oracle.oracle_sql()[name]).df()[have.columns]
    assert sorted(map(tuple, have.collect())) == sorted(want.itertuples(index=False, name=None))
