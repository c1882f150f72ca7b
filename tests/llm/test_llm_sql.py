"""Every query of the subpackage that has SQL equals it on the smallest tables."""

import os

import duckdb
import pytest

from tessera.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    have = sorted((tuple(r) for r in got.select(columns).collect()), key=str)
    found = duck.execute(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert have and have == sorted(found, key=str)
