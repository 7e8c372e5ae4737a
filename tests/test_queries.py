"""Every query of the library against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillon.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    return v.isoformat()[:19].replace("T", " ") if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    out = duck.execute(SQL[name])
    cols = [d[0] for d in out.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in sorted(cols)]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)


def test_entry_imports_without_the_llm_folder():
    import subprocess
    import sys

    code = "import sys; sys.modules['quillon.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 60"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
    missing = code.replace("sys.modules['quillon.llm'] = None; sys.modules['corpus_pipeline'] = None", "sys.modules['zstandard'] = None")
    subprocess.run([sys.executable, "-c", missing], check=True, cwd=Path(__file__).resolve().parent.parent)
