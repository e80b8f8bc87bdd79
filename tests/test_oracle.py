"""Every registered query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera import registry, runtime

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    yield con
    con.close()


def cell(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    runtime.ship(spark)
    got = registry.queries()[name](spark, DATA)
    rows = got.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    left = sorted(tuple(cell(r[c]) for c in order) for r in rows)
    right = sorted(tuple(cell(r[names.index(c)]) for c in order) for r in want.fetchall())
    assert left == right


def test_deflated_artifacts_are_intact(spark):
    rows = registry.queries()["artifact_deflate"](spark, DATA).collect()
    assert all(r["intact"] for r in rows) and sum(r["compressed_size"] for r in rows) < sum(r["size"] for r in rows)
