"""Every query with SQL against DuckDB, on the smallest tables."""

import glob
import math

import duckdb
import pytest

from tidewindow.plans import catalog, tiers  # noqa: F401

SF = "/root/testdata/sf0.001"


def key(row):
    return tuple("~" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.6f}" if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else str(x) for x in row)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracles))
def test_same_as_sql(spark, duck, name):
    df = catalog.queries[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracles[name]})").fetchall()
    assert sorted(map(key, df.select(*columns).collect())) == sorted(map(key, want)) and want
