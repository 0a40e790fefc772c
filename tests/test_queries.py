"""Queries against their SQL, run by DuckDB over the same files."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from plumbline.plans import catalogue
from plumbline.plans.oracles import oracles

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()
CHECKED = sorted(oracles())


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or value != value:
        return ""
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else f"{value:.5f}"
    return str(value)[:10] if isinstance(value, (datetime.date, datetime.datetime)) else str(value)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_gives_what_its_sql_gives(spark, duck, name):
    assert rows_of(catalogue.queries()[name](spark, DATA).toPandas()) == rows_of(duck.sql(oracles()[name]).df())


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(oracles())
