"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from clausewright.plans import books, delta, evidence, records, rules, scoring, text

FOLDER = "/root/testdata/sf0.001"
PLANS = (books, delta, evidence, records, rules, scoring, text)
QUERIES = {name: f for plan in PLANS for name, f in plan.QUERIES.items()}
SQL = {name: sql for plan in PLANS for name, sql in plan.SQL.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(v):
    if isinstance(v, np.ndarray):
        return [plain(x) for x in v]
    if v is None or str(v) in ("<NA>", "nan", "NaT", "None"):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return round(float(v), 9)
    return str(v).removesuffix(" 00:00:00")


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(map(plain, r))) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = rows(QUERIES[name](spark, FOLDER).toPandas())
    if name in SQL:
        assert got == rows(duck.sql(SQL[name]).df())
    else:
        assert got[0]
