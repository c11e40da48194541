"""Every curation query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gleanery.plans import registered

SQL = registered.oracle_sql()


def tidy(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(tidy(y) for y in x) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def con(sf):
    made = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        made.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return made


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, con, name):
    df = registered.queries()[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted((tidy(tuple(r[c] for c in cols)) for r in df.collect()), key=repr)
    theirs = con.execute(SQL[name])
    at = {d[0]: i for i, d in enumerate(theirs.description)}
    assert sorted(at) == cols
    assert ours == sorted((tidy(tuple(r[at[c]] for c in cols)) for r in theirs.fetchall()), key=repr)
