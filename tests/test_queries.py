"""Every query with SQL against DuckDB, on the smallest tables and on some of several partitions."""

import os

import duckdb
import pytest

from kinfold.plans.queries import ORACLES, QUERIES

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def cells(frame):
    frame = frame[sorted(frame)]
    value = lambda v: None if v is None or v != v else repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(str([value(v) for v in row]) for row in frame.astype(object).where(frame.notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck():
    def over(folder):
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        for f in os.listdir(folder):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
        return con

    return {folder: over(folder) for folder in (DATA, LARGER) if os.path.isdir(folder)}


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("folder", [DATA, LARGER])
def test_same_rows(spark, duck, name, folder):
    if folder not in duck:
        pytest.skip("no tables")
    got, expected = QUERIES[name](spark, folder).toPandas(), duck[folder].execute(ORACLES[name]).df()
    assert sorted(got) == sorted(expected)
    assert cells(got) == cells(expected)


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = QUERIES["infer_filter_mean"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice" in plan and "o_custkey" not in plan.split("ReadSchema")[1]
