"""The driver's contract."""

import os
import subprocess
import sys

import pytest

import __spark_entry__


def test_names_match():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 380 and all(callable(q) for q in queries.values())


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; from pyspark import SparkContext as c; assert c._active_spark_context is None; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    got = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    assert got.stdout.split() == [str(len(__spark_entry__.queries())), str(len(__spark_entry__.oracle_sql()))]


@pytest.mark.skipif(not os.path.isdir(__spark_entry__.SMOKE_DIR), reason="test tables are not here")
def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 4 and rows[0]["max"] >= rows[0]["min"]
