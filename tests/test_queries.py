"""Every query against its SQL in DuckDB, and against the tables' smallest size."""

import duckdb
import pandas as pd
import pytest

from tessera_spark.plans import bridge

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NA or v != v:
        return ""
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def canonical(df, columns):
    return sorted(tuple(cell(v) for v in row) for row in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(bridge.QUERIES))
def test_query(spark, con, name):
    got = bridge.QUERIES[name](spark, SF).toPandas()
    if name in bridge.SQL:
        want = con.execute(bridge.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got, sorted(got.columns)) == canonical(want, sorted(got.columns))


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_equals_batch(spark):
    """Bursts that the stream has closed are those of the batch form, sizes included."""
    stream = bridge.QUERIES["coalesced_refresh_stream"](spark, SF).groupBy("user_id", "n_requests").count().collect()
    batch = {(r["user_id"], r["n_requests"]): r["count"] for r in bridge.QUERIES["coalesced_refresh"](spark, SF).groupBy("user_id", "n_requests").count().collect()}
    assert all(r["count"] <= batch.get((r["user_id"], r["n_requests"]), 0) for r in stream)
