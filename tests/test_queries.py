"""Every engine query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

from tessera.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    rows = duck.execute(ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(dict(zip(names, r, strict=True))[c]) for c in columns) for r in rows.fetchall())
    assert got == want


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
