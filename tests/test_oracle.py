"""Every registered query with an oracle equals its DuckDB SQL on sf0.001."""

from __future__ import annotations

import os

import pytest

from tests.conftest import SF_SMALL
from tools.oracle_check import digest, duck

import __spark_entry__ as E

SQLS = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(SQLS[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(rel.columns, drows)[0]


def test_every_query_is_registered_with_ids():
    from basketry.plans.catalog import REGISTRY
    assert all(q.ids for q in REGISTRY.values())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["state", "product_id", "score", "rank"]
