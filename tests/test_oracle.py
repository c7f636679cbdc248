"""Every registered query against its SQL; ORACLE_SF picks the tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as registered
from tests.oracle_check import compare, connect

SF_DIR = f"/root/testdata/{os.environ.get('ORACLE_SF', 'sf0.001')}"
QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    plans = []

    def query(session, sf_dir):
        df = QUERIES[name](session, sf_dir)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    same, detail = compare(spark, con, SF_DIR, query, SQL.get(name))
    assert same, detail
    assert "CartesianProduct" not in plans[0] and "BroadcastNestedLoopJoin" not in plans[0]


def test_entry_runs(spark):
    rows = registered.entry(spark).collect()
    assert len(rows) == 25
    assert set(rows[0].asDict()) == {"tenant_id", "total_overdue_amount", "overdue_invoice_count"}
