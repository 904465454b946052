import duckdb
import pytest

import __spark_entry__ as entry
from sastra.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_finds_something(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    rows = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == rows


def test_snippet_scan_holds_every_layer(spark):
    got = {r["analyzer"] for r in entry.queries()["snippet_scan"](spark, DATA).collect()}
    assert got == {"regex", "ast", "call", "secret"}
