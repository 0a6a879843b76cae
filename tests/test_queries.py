"""Every query with an SQL equivalent against DuckDB; the others must run.  Uses the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lectern.plans.registry import load_all

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(df):
    def cell(v):
        if v is None:
            return "null"
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, int | float):
            return "null" if isinstance(v, float) and math.isnan(v) else repr(round(float(v), 5) + 0.0)
        return "null" if str(v) in ("NaT", "<NA>") else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        assert normal(got) == normal(duck.execute(ORACLES[name]).df())
