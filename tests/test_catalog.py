"""Every query of the catalogue against its SQL, and every other query for a stable, non-empty result."""

import math
import os

import duckdb
import pytest

from calspark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    con.execute("set TimeZone = 'UTC'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(norm(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_and_repeats(spark, name):
    q = catalog.queries()[name]
    first, again = (sorted(map(tuple, q(spark, DATA).collect()), key=repr) for _ in range(2))
    assert first and first == again


def test_oracles_belong_to_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
