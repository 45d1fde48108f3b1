"""Every registered query with SQL must agree with it on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from mnemospark.plans.catalog import OPERATORS, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        path = f"{SF}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, str):
        return value
    if type(value).__name__.startswith("bool"):
        return bool(value)
    if hasattr(value, "__iter__"):
        return tuple(map(plain, value))
    return round(float(value), 5)


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    frame = QUERIES[name](spark, SF)
    assert frame.count() > 0 and frame.columns


@pytest.mark.parametrize("name", ["scoped_units", "fact_scorecard", "reinforced_edges", "keyframes", "batch_reconcile"])
def test_sql_that_is_compared_has_rows(duck, name):
    assert len(duck.sql(ORACLE_SQL[name]).df()) > 1


def test_every_query_names_its_operators():
    assert all(OPERATORS[name] for name in QUERIES)
