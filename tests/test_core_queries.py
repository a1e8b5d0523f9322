"""Every core query against its oracle SQL, and the others for rows, on the smallest tables."""

import duckdb
import pytest

from orderloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    return int(value) if isinstance(value, float) and value == int(value) else value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    relation = duck.sql(sql)
    assert sorted(relation.columns) == cols
    at = [relation.columns.index(c) for c in cols]
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in relation.fetchall())


def test_entry(spark):
    assert registry.entry(spark, SF).count() > 0
