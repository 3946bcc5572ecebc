import os

import duckdb
import pytest

import __spark_entry__
from sluice.plans import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return sorted((tuple(str(r[n]) for n in names) for r in table.select(names).to_pylist()), key=str), names


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got, names = rows(catalogue.QUERIES[name](spark, DIR).toArrow())
    if name in catalogue.SQL:
        want, want_names = rows(duck.execute(catalogue.SQL[name]).to_arrow_table())
        assert names == want_names and got == want
    assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
