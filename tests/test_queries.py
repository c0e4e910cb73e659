"""Every registered query against DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from evalsweep.plans.oracle import ORACLE_SQL as SQL
from evalsweep.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    rows = [tuple(frame_row) for frame_row in frame.itertuples(index=False)]
    return sorted(rows, key=lambda row: tuple((v is not None, str(v)) for v in row))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    ours, theirs = result.toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs) > 0
    for mine, other in zip(canonical(ours), canonical(theirs)):
        assert mine == other


def test_entry(spark):
    assert contract.entry(spark).count() == 16
