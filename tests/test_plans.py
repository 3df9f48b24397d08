"""Every SQL-expressible query of the engine against its oracle, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from vicinal.plans.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = list(oracle_sql())


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    def one(x):
        if isinstance(x, list | tuple | np.ndarray):
            return tuple(one(y) for y in x)
        if x is None or x is pd.NA or (isinstance(x, float | np.floating) and np.isnan(x)):
            return None
        return float(x) if isinstance(x, int | float | np.integer | np.floating | bool | np.bool_) else str(x)

    return sorted((tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    assert plain(queries()[name](spark, SF).toPandas()) == plain(con.sql(oracle_sql()[name]).df())


def test_registry():
    assert set(queries()) - set(oracle_sql()) == {"router_train", "feasibility"} and set(oracle_sql()) <= set(queries())
    assert len(queries()) == 97


def test_entry(spark):
    import __spark_entry__ as e

    assert set(queries()) <= set(e.queries())
    if os.path.isdir(SF):
        assert e.entry(spark).count() > 0
