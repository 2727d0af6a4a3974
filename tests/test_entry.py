"""The driver's contract, and every registered query against its SQL over the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from millrace import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        return f"{v:.9g}" if isinstance(v, float) else str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(str(one(v)) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, db, name):
    got = own.QUERIES[name](spark, SF).toPandas()
    if name in own.ORACLE:
        want = db.sql(own.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert shown(got) == shown(want)
    else:
        assert len(got)
