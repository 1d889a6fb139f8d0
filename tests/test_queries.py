"""Every query that has SQL gives what DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from docloom.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, sql, name):
    df = QUERIES[name](spark, sf)
    found = sql.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.columns, df.collect()) == plain(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "category", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())
