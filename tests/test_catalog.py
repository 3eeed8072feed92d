"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from kgflow import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted([normal([r[c] for c in cols]) for r in df.collect()], key=repr)
    if name not in catalog.SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    con.execute(catalog.SQL[name])
    have = [d[0] for d in con.description]
    assert sorted(have) == cols
    assert got == sorted([normal([r[have.index(c)] for c in cols]) for r in con.fetchall()], key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["a_id", "b_id", "from_m", "to_m"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
