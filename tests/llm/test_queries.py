from pathlib import Path

import duckdb
import pytest

from shelfspark.llm import registry


@pytest.fixture(scope="module")
def duck(small_data):
    connection = duckdb.connect()
    for path in Path(small_data).iterdir():
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, small_data, name):
    found = registry.queries()[name](spark, small_data)
    columns = sorted(found.columns)
    wanted = duck.sql(registry.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(found.select(*columns).collect()) == key(wanted.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, small_data, name):
    found = registry.queries()[name](spark, small_data)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)
