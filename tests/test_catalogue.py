"""Every registered query against its SQL on the driver tables, and coverage of the inventory."""

import duckdb
import pytest

from brindle.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((repr([r[i] for i in order]) for r in data))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    want = db.sql(catalogue.ORACLE_SQL[name])
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_inventory_is_covered():
    covered = {n for numbers in catalogue.COVERS.values() for n in numbers}
    assert covered == set(range(1, 157))
