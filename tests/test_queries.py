"""Every query that has SQL gives the same rows in both engines; the rest run."""

import duckdb
import pytest

from vellum.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def shown(v):
    return "null" if v is None or v != v else repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(catalog.ORACLE[name])
    named = [d[0] for d in res.description]
    assert sorted(named) == cols
    theirs = sorted(tuple(shown(r[named.index(c)]) for c in cols) for r in res.fetchall())
    assert ours and ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())
