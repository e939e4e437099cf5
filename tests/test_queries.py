"""Every registered query with SQL against DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


def rows(frame):
    """Rows as sorted text: nulls of any kind alike, whole numbers alike whatever their type."""
    frame = frame[sorted(frame.columns)].astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None"})
    for c in frame.columns:
        frame[c] = frame[c].str.replace(r"\.0$", "", regex=True)
    return sorted(frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = entry.queries()[name](spark, DIR).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["direction", "id", "name", "kind", "path", "start_line", "depth"]
