"""Every query with SQL equals DuckDB at the smallest scale; the entry works without the llm subpackage."""

from __future__ import annotations

import glob
import numbers
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from bagflow.jobs import registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def shown(v):
    """One text for equal values, whatever library they come from."""
    if pd.isna(v):
        return ""
    return str(round(float(v), 6)) if isinstance(v, numbers.Number) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(shown, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_sql(spark, sf, con, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_without_llm(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['bagflow.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'majority_direction' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
