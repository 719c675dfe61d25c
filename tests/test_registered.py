import duckdb
import pytest
from check_oracle import TABLES, difference
from conftest import SMALL

import __spark_entry__ as entry
from weirlog import oracle
from weirlog import queries as registered

QUERIES, STATEMENTS = registered.ALL, oracle.statements()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(entry.queries()) and set(STATEMENTS) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).first().total_requests == 570


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql_and_stays_in_the_engine(spark, database, name):
    frame = QUERIES[name](spark, SMALL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas"):
        assert operator not in plan
    assert difference(frame.toPandas(), database.sql(STATEMENTS[name]).df()) is None
