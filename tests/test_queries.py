"""Every registered query that has SQL gives the SQL's rows; the others run. Over the driver's smallest tables."""

from __future__ import annotations

import os

import pandas as pd
import pytest

from tessera.plans import registry

SF = os.environ.get("TESSERA_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    frame = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    got = frame.toPandas()
    if sql is None:
        assert list(got.columns)
        return
    want = oracle.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    tidy = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, rtol=0, atol=0)
