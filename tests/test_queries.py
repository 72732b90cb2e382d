"""Every query with SQL against DuckDB, on the smallest driver tables."""

import duckdb
import pytest

from gridloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def comparable(rows):
    return sorted(tuple(str(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in plans.ORACLE_SQL:
        assert got
        return
    result = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in result.fetchall()]
    assert comparable(got) == comparable(want)


def test_entry_without_subpackage(spark):
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 25
