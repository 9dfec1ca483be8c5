"""Every registered query with SQL gives what DuckDB gives on the same tables; the others run."""

import duckdb
import pytest

import __spark_entry__ as entry
from spendloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    return repr(v) if isinstance(v, float) else str(v)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    if name not in plans.SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = con.execute(plans.SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(text(r[k]) for k in at) for r in rows.fetchall())
