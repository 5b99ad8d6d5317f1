import importlib
import pkgutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import shelfspark
from shelfspark.queries import registry

ROOT = Path(__file__).parent.parent


def rounded(rows):
    out = []
    for row in rows:
        out.append(tuple("null" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in row))
    return sorted(out)


@pytest.fixture(scope="module")
def duck(small_data):
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in Path(small_data).iterdir():
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, small_data, name):
    found = registry.queries()[name](spark, small_data)
    columns = sorted(found.columns)
    wanted = duck.sql(registry.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    assert rounded(tuple(r) for r in found.select(*columns).collect()) == rounded(wanted.select(*[f'"{c}"' for c in columns]).fetchall())


def test_queries_without_sql_run(spark, small_data):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, small_data).columns


def test_nothing_imports_the_llm_subpackage():
    code = "import sys; sys.modules['shelfspark.llm'] = None\n" + "\n".join(
        f"import {m.name}" for m in pkgutil.walk_packages(shelfspark.__path__, "shelfspark.") if not m.name.startswith("shelfspark.llm")
    ) + "\nimport __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(n[0] == 'p' and n[1] in '12' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=120)


def test_entry_has_both_parts():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
