"""Every query of the library against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from tallyfield.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MAY_BE_EMPTY = {"agg_having", "join_fuzzy"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (np.ndarray, list, tuple)):
        return [plain(x) for x in v]
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, (float, np.floating)) and np.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.number, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (datetime.date, datetime.datetime)):
        return pd.Timestamp(v).isoformat()
    return v


def rows(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(x) for x in r]) for r in df[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name in catalog.oracle_sql():
        assert rows(got) == rows(con.sql(catalog.oracle_sql()[name]).df())
    else:
        assert len(got) or name in MAY_BE_EMPTY


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.queries()


def test_no_query_without_reason_lacks_sql():
    assert len(catalog.oracle_sql()) >= 0.9 * len(catalog.queries())
