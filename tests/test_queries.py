"""Registered queries: some against their SQL on the smallest tables, and what they cover."""
import duckdb
import pytest

import __spark_entry__ as entry
from tools_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
NAMES = ("payment_ladder", "step_flags", "chain_outcomes", "step_matrix", "direct_survival", "net_by_subscription", "running_refund_cap", "population",
         "invoice_bursts", "order_outcomes", "terminal_events", "attribution_as_of", "averaged_curve", "last_decline", "long_pauses", "parallel_subscriptions")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_inventory_is_covered():
    from tenurekit.plans import load
    from tenurekit.plans.registry import COVERS

    load()
    have = {i for v in COVERS.values() for i in v.split()}
    sizes = dict(S=10, F=13, J=13, A=17, W=13, K=5, U=5, X=16, E=27, M=15, R=11, P=22, H=20, C=13, L=11, V=20, Q=18, B=8)
    assert not [f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1) if f"{k}{i}" not in have]


def test_plans_have_no_cartesian_product(spark):
    for name in ("step_matrix", "direct_survival", "revenue_by_key", "cohort_facts", "dunning_percentiles", "frozen_backtest"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
