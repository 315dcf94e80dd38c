"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from parcelflow import job_queries, queries

QUERIES, ORACLE_SQL = {**queries.QUERIES, **job_queries.QUERIES}, {**queries.ORACLE_SQL, **job_queries.ORACLE_SQL}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if pd.api.types.is_numeric_dtype(frame[c]) and not pd.api.types.is_bool_dtype(frame[c]):
            frame = frame.assign(**{c: frame[c].astype(float)})
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, sf, duck, name):
    ours, sql = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert len(ours) == len(sql)
    assert len(ours) or name in ("missing_inputs",)
    pd.testing.assert_frame_equal(canonical(ours), canonical(sql), check_dtype=False, rtol=1e-9, atol=1.1e-6)
