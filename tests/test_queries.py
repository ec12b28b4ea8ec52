"""Every registered query of the library against its SQL."""

import duckdb
import pytest

import __spark_entry__
from tintwalk.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    order = lambda rows: sorted(rows, key=lambda r: tuple(map(str, r)))
    assert order(tuple(r) for r in df.select(*columns).collect()) == order(cur.fetchall())


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 249
