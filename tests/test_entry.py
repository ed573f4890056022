"""Registered queries against their SQL on the smallest data, where it is there."""

import collections
import os
import warnings

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def _plans():
    from colloquy.plans import oracle, queries

    return queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def bag(rows):
    def plain(v):
        return float(f"{v:.9g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    return collections.Counter(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(_plans()[0]))
def test_query(spark, db, name):
    queries, oracle = _plans()
    df = queries[name](spark, SF)
    if name not in oracle:
        assert df.columns and df.count() >= 0
        return
    cur = db.execute(oracle[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert bag(tuple(r) for r in df.select(names).collect()) == bag(want)


def test_entry(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        import __spark_entry__

        assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
        assert __spark_entry__.entry(spark).count() > 0
