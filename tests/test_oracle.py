"""Every registered query of the reference's operators against its SQL."""

import glob
import os

import duckdb
import pytest

from strandex.plans import catalog

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    out = []
    for r in df:
        out.append(tuple(round(float(x), 5) + 0.0 if isinstance(x, float) else x for x in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*columns).collect())
    if name in catalog.SQL:
        want = rows(duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.SQL[name]})").fetchall())
        assert got == want
    else:
        assert got
