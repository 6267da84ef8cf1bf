"""Every registered query against its SQL, on the smallest driver tables where those are there."""

import os

import pytest

from lodestone.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(columns, rows):
    return sorted(repr(sorted(zip(columns, (list(v) if isinstance(v, (list, tuple)) else v for v in r)))) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    rows = plain(got.columns, got.collect())
    if name in catalogue.oracle_sql():
        cursor = duck.execute(catalogue.oracle_sql()[name])
        assert rows == plain([c[0] for c in cursor.description], cursor.fetchall())
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
