"""Every query with SQL gives the rows that DuckDB gives; the entry works with and without the subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

from quaver.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    if name not in catalogue.ORACLE_SQL:
        return
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"create view {file[:-8]} as select * from '{sf}/{file}'")
    found = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr([r[n] for n in sorted(names)]) for r in rows) == sorted(repr([r[names.index(n)] for n in sorted(names)]) for r in found.fetchall())


def test_entry_without_subpackage():
    code = "import sys; sys.modules['quaver.llm'] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalogue.QUERIES))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert done.stdout.strip() == "True", done.stderr
