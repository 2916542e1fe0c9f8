"""Every registered plan against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from docspark.plans import dialect, registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in dialect.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    cols = sorted(df.columns)
    return sorted((tuple(map(one, r)) for r in df[cols].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_plan_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_smoke(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
