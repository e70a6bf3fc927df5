"""The queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from kinfold.llm.queries import ORACLES, QUERIES

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("folder", [DATA, LARGER])
def test_same_rows(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    a, b = con.execute(ORACLES[name]).df(), QUERIES[name](spark, folder).toPandas()
    assert sorted(a) == sorted(b)
    rows = lambda f: sorted(map(str, f[sorted(f)].astype(object).where(f[sorted(f)].notna(), None).values.tolist()))
    clean = lambda f: [r.replace(".0,", ",").replace(".0]", "]") for r in rows(f)]
    assert clean(a) == clean(b)
