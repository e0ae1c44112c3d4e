"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

from basisloom.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    got = QUERIES[name](spark, FOLDER)
    want = oracle.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, FOLDER).count() >= 0


def test_risk_parity_shares_are_equal(spark):
    shares = [r["risk_share"] for r in QUERIES["risk_parity_weights"](spark, FOLDER).collect()]
    assert sum(shares) == pytest.approx(1) and max(shares) - min(shares) < 1e-3
