"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidegrid.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.5g}" if value else "0"
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sql, name):
    mine = registry.queries()[name](spark, DATA)
    theirs = sql.sql(registry.oracle_sql()[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in mine.collect())
    order = [theirs.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
