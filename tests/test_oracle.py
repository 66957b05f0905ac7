"""Every registered query with SQL gives the same rows on DuckDB, and no plan holds a cross join."""

import duckdb
import pytest

from paths import SF_DIR
from tools.check_oracle import TABLES, rows

from steadymark.catalog.oracle import all_sql
from steadymark.catalog.queries import all_queries

SQL = all_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    df = all_queries()[name](spark, SF_DIR)
    cursor = db.execute(SQL[name])
    names = [column[0] for column in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cursor.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(all_queries())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 27
