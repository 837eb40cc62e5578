"""Every core query against its SQL over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quillstack.plans import catalogue
from tests.conftest import DATA

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in ORACLE:
        want = sql.execute(ORACLE[name]).fetch_df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)
