import duckdb
import pytest

from sluice.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).to_arrow_table()
    got = queries.queries()[name](spark, DIR).toArrow()
    names = sorted(want.column_names)
    rows = lambda t: sorted(tuple(r[n] for n in names) for r in t.select(names).to_pylist())
    assert sorted(got.column_names) == names and rows(got) == rows(want)


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
