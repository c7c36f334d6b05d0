import duckdb
import pytest

import __spark_entry__ as entry_point
from tessella.plans import queries as Q
from tessella.plans import studies  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(Q.SQL))
def test_query_equals_sql(spark, small, duck, name):
    df = Q.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    result = duck.sql(Q.SQL[name])
    assert sorted(result.columns) == columns
    want = sorted([tuple(plain(r[result.columns.index(c)]) for c in columns) for r in result.fetchall()], key=repr)
    assert sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr) == want


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
