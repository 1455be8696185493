"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from repolens.sources.tables import TABLES, table_path

from .conftest import SMALL

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SMALL, t)}')")
    return c


def test_every_query_has_a_callable():
    assert QUERIES and all(callable(q) for q in QUERIES.values())
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    s_cols, s_rows = _canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLE[name])
    o_cols, o_rows = _canon([d[0] for d in res.description], res.fetchall())
    assert s_cols == o_cols
    assert len(s_rows) == len(o_rows)
    assert s_rows == o_rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()  # all columns; a count would prune them
    assert rows
    assert any(v is not None for v in rows[0])


def test_session_time_zone_does_not_shift_windows(spark, con):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_matches_oracle(spark, con, "fixed_window_quota")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "repo_id" in df.columns
