"""Registered queries against DuckDB on the smallest tables (families that run fast)."""

import math

import duckdb
import pytest

from splatlake import fixtures as fx, queries

queries.load()
PREFIXES = ("p1_", "p2_", "p3_", "p6_", "j7_", "j8_", "j9_", "j12_", "w3_", "w4_", "w6_", "m1_dilate", "u3_", "u4_sub", "a9_", "a20_", "a27_", "a30_", "j14_", "j16_", "f6_", "f4_", "s17_", "e4_")
NAMES = [n for n in queries.ORACLES if n.startswith(PREFIXES)]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in fx.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in rel.description]
    want = sorted((tuple(norm(v) for v in r) for r in rel.fetchall()), key=repr)
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert sorted((tuple(norm(v) for v in r) for r in got.select(*cols).collect()), key=repr) == want


def test_every_oracle_has_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
