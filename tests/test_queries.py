"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from curvecal.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
SLOW = {"fit_gbt", "study_features", "study_features_robust", "fit_forest"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) else str(v)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, [tuple(map(cell, r)) for r in frame[columns].itertuples(index=False)]


def order(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    cols, got = rows_of(QUERIES[name](spark, FOLDER).toPandas())
    want_cols, want = rows_of(duck.sql(SQL[name]).df())
    assert cols == want_cols and len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order)):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, abs=2e-6, rel=1e-9) if isinstance(y, float) else y)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
