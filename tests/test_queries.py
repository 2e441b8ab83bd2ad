"""Every query against its SQL on the smallest tables, and the shape of the others."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from cloakframe.plans import more_queries, scan_queries  # noqa: F401
from cloakframe.plans import queries as Q


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    return round(float(v), 6) if isinstance(v, (int, float)) else str(v)


def table(df):
    return sorted((tuple(plain(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(Q.QUERIES), ids=str)
def test_query(spark, sf, sql, name):
    got = Q.QUERIES[name](spark, sf).toPandas()
    if name in Q.ORACLE:
        expected = sql.execute(Q.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert table(got) == table(expected)
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "source", "masked", "n_spans", "counts"] and df.count() > 0
