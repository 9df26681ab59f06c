import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from poregrid import queries as core


@pytest.fixture(scope="module")
def sql(data_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{data_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_entry_and_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p5_found", "p6_found", "sc_priority_rank"} <= set(entry.queries())


def test_flagship(spark, data_dir):
    got = entry.entry(spark)
    assert got.columns == ["sc_id", "priority", "prioritized_id"] and got.count() > 0


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, sql, data_dir, name):
    have = core.queries()[name](spark, data_dir)
    want = sql.sql(core.oracle_sql()[name]).df()
    columns = sorted(have.columns)
    assert columns == sorted(want.columns)

    def norm(df):
        text = lambda v: "null" if pd.isna(v) else str(float(v)) if isinstance(v, numbers.Number) else str(v)
        return sorted(tuple(map(text, r)) for r in df[columns].itertuples(index=False))

    assert norm(have.toPandas()) == norm(want)
