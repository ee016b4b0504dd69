from __future__ import annotations

import duckdb
import pytest

from skarn.plans import ORACLE_SQL, QUERIES

from .compare import DATA, duck_rows, oracle, spark_rows


@pytest.fixture(scope="module")
def con():
    return oracle()


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_oracle(spark, con, name):
    names, rows = spark_rows(QUERIES[name](spark, DATA))
    assert (names, rows) == duck_rows(con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_bernoulli_is_repeatable_and_near_its_share(spark):
    q = QUERIES["s13_sample_bernoulli"]
    n = q(spark, DATA).count()
    assert n == q(spark, DATA).count() and 400 < n < 800


def test_epoch_millis_of_far_keys(spark, tmp_path):
    """Keys of larger tables are days after the year 9999, which Python's dates can't hold: read by DuckDB."""
    spark.createDataFrame([(0,), (2932896,), (2932897,), (8999999,)], "o_orderkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    QUERIES["d12_epoch_millis"](spark, str(tmp_path)).write.parquet(str(tmp_path / "got"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    shown = "SELECT o_orderkey, CAST(d AS VARCHAR) AS d, t FROM "
    assert duck_rows(con, f"{shown} read_parquet('{tmp_path}/got/*.parquet')") == duck_rows(con, f"{shown} ({ORACLE_SQL['d12_epoch_millis']})")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
