"""Every query with SQL gives what DuckDB gives on the same tables; the others run."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "~"
        if isinstance(v, float):
            v = round(v, 9)
            return str(int(v)) if v == int(v) else repr(v)
        return str(v.item()) if hasattr(v, "item") else str(v)

    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_entry_and_names(spark):
    out = entry.entry(spark)
    assert out.columns == ["url", "snapshot_no", "change_kind"] and out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    if name in entry.oracle_sql():
        want = duck.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
