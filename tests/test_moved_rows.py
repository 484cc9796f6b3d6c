"""Rows that a step reads, sorts or shuffles: once, and not more columns than it needs."""
import datetime as dt
import re

from pyspark.sql import functions as F

from tenurekit.operators import clean as C
from tenurekit.operators import cohorts as K
from tenurekit.operators import ladder as L
from tenurekit.params import ORDERS as P
from tenurekit.params import ORDERS_WEB as PW


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payments_are_numbered_once_for_all_parts_of_the_facts(spark):
    pays = spark.createDataFrame([(s, k, 20.0 + k) for s in range(6) for k in range(s + 1)], "sub_id long, rebill_number long, amount double")
    members = spark.createDataFrame([(s, dt.date(2024, 1, 1)) for s in range(6)], "sub_id long, cohort date")
    f = K.cohort_facts(pays, members, F.lit("2027-12-01 00:00:00").cast("timestamp"), PW)
    assert "rebill_number" in plan(pays) and "sub_id" in plan(pays) and "sub_id" not in plan(f)
    got = {r.rebill_number: (r.payers, r.active_users, r.revenue, r.cumulative_revenue) for r in f.collect()}
    assert got[0] == (6, 6, 120.0, 120.0) and got[2] == (6, 4, 88.0, 120.0 + 105.0 + 88.0)


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=s)


def test_steps_and_attributes_of_a_log_without_structs_per_row(spark):
    rows = [(1, at(0), "pay", "subscription_renewed", 1, "a", None, "m"), (1, at(3), "vol", "x", 2, None, None, None), (1, at(40), "pay", "subscription_renewed", 3, "b", "g", None),
            (2, at(5), "pay", "subscription_renewed", 4, None, None, None), (2, at(6), "issue", "y", 5, None, None, None)]
    log = spark.createDataFrame(rows, "sub_id long, ts timestamp, kind string, event_name string, tie long, app_id string, geo string, media_source string")
    s = L.step_flags(log, P)
    assert not re.search(r"_kept#\d+ THEN struct", plan(s))
    assert sorted((r.sub_id, r.step_k, r.tie, r.had_issue, r.had_vol) for r in s.collect()) == [(1, 1, 1, False, True), (1, 2, 3, False, False), (2, 1, 4, True, False)]
    got = {(r.sub_id, r.step_k): (r.app_id, r.geo, r.media_source) for r in L.mobile_matrix(log, P).collect()}
    assert got == {(1, 1): ("a", "g", "m"), (1, 2): ("a", "g", "m"), (2, 1): (None, "(none)", "(none)")}


def test_the_earliest_copy_and_the_latest_snapshot_move_their_texts_once(spark):
    raw = spark.createDataFrame([("e", "t", at(1), "b"), ("e", "u", at(1), "a"), ("e", "v", at(2), "0"), ("f", "t", None, None)], "event_id string, event_type string, created timestamp, data string")
    d = C.dedup_by_id(raw)
    assert d.columns == raw.columns and "min_by" not in plan(d)
    assert sorted((r.event_id, r.event_type, r.data) for r in d.collect()) == [("e", "u", "a"), ("f", "t", None)]
    order = '{"subscription": {"id": "s"}, "invoices": {"i": {"orders": {"o": {"status": "%s", "amount": "%s", "processed_at": "%s"}}}}}'
    b = spark.createDataFrame([(1, "x", at(1), order % ("new", "5", "")), (2, "x", at(1), order % ("done", "7", "2024-01-02 00:00:00"))], "event_id long, event_type string, created timestamp, data string")
    o = C.orders_b(C.parse_b(b))
    assert "max_by" not in plan(o)
    assert [(r.order_id, r.subscription_id, r.invoice_id, r.status, r.amount_cents, r.processed_at, r.seen_at) for r in o.collect()] == [("o", "s", "i", "done", 7, at(1), at(1))]
