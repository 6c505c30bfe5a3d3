"""Queries against their SQL on the smallest tables, and that the rest stands without the llm subpackage."""

import glob
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lintlake import catalog
from tests.data import SMALL


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rel = con.execute(catalog.SQL[name])
    head = [c[0] for c in rel.description]
    assert sorted(head) == columns
    mine = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
    theirs = sorted(repr([norm(r[head.index(c)]) for c in columns]) for r in rel.fetchall())
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_llm():
    root = Path(entry.__file__).parent
    for p in (root / "lintlake").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lintlake.llm" not in p.read_text()
    code = "import sys; sys.modules['lintlake.llm'] = None; import __spark_entry__ as e; assert e.llm_queries is None; assert 'p6_found' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
