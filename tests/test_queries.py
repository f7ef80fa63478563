"""Registered queries against their SQL in DuckDB, and properties of those without SQL."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from tracewright.plans import more_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def normal(df):
    df = df[sorted(df.columns)].copy()

    def shown(v):
        if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)) else str(v)

    for c in df:
        df[c] = df[c].map(shown)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, db, name):
    got = normal(queries.QUERIES[name](spark, SF).toPandas())
    want = normal(db.execute(queries.SQL[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_give_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() > 0 and not any(c.startswith("_") for c in df.columns)


def test_read_back_images_are_close(spark):
    got = queries.QUERIES["digitized_curves"](spark, SF)
    assert got.filter("coverage < 0.97").count() == 0


def test_drawn_images_do_not_leave_their_task(spark):
    plan = queries.QUERIES["digitized_curves"](spark, SF)._jdf.queryExecution().toString()
    assert plan.count("binary") == 0 and "content" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
