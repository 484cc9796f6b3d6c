"""Boundary cases of the semantics."""
import pytest
from pyspark.sql import functions as F

from tenurekit.functions.exprs import clip, interval_word, period_of_life, url_dim, whole_days
from tenurekit.operators import clean as C
from tenurekit.operators import hazard as H
from tenurekit.operators import ladder as L
from tenurekit.operators import ltv as V
from tenurekit.params import MOBILE, WEB


@pytest.fixture
def events(spark):
    def make(*rows):
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "sub_id string, t string, kind string, tie long")
        return df.selectExpr("sub_id", "cast(t as timestamp) ts", "kind", "tie")

    return make


def test_gap_of_exactly_three_days_is_dropped(events, rows):
    e = events(("a", "2024-01-01 00:00:00", "pay"), ("a", "2024-01-04 00:00:00", "pay"), ("a", "2024-01-07 00:00:01", "pay"))
    got = rows(L.payment_ladder(e.drop("kind"), MOBILE), "step_k")
    assert [r["tie"] for r in got] == [0, 2]


def test_dedup_looks_at_the_previous_raw_payment(events, rows):
    e = events(("a", "2024-01-01", "pay"), ("a", "2024-01-03", "pay"), ("a", "2024-01-05", "pay"))
    assert len(rows(L.payment_ladder(e.drop("kind"), MOBILE))) == 1


def test_state_event_at_a_payment_belongs_to_the_step_before(events, rows):
    e = events(("a", "2024-01-01", "pay"), ("a", "2024-01-08", "issue"), ("a", "2024-01-08", "pay"), ("a", "2024-01-01", "vol"))
    got = rows(L.step_flags(e, MOBILE), "step_k")
    assert [(r["had_issue"], r["had_vol"]) for r in got] == [(True, False), (False, False)]


@pytest.mark.parametrize("days,expect", [(60, "recovered"), (61, "churned"), (10, "renewed"), (11, "recovered")])
def test_window_edges(events, rows, days, expect):
    e = events(("a", "2024-01-01", "pay")).unionByName(events(("a", "2024-01-01", "pay")).select(
        "sub_id", (F.col("ts") + F.make_dt_interval(F.lit(days))).alias("ts"), "kind", F.lit(9).cast("bigint").alias("tie")))
    st = L.step_flags(e, MOBILE).withColumn("o", L.outcome(MOBILE))
    assert rows(st, "step_k")[0]["o"] == expect


def test_week_before_entry_is_week_zero(spark, rows):
    df = spark.sql("select timestamp'2024-01-10' f, timestamp'2024-01-09 23:00:00' t")
    r = rows(df.select(period_of_life("f", "t", 7).alias("w"), whole_days("f", "t").alias("d")))[0]
    assert r == {"w": 0, "d": -1}


@pytest.mark.parametrize("second,n", [("00:05:00", 1), ("00:05:01", 2)])
def test_burst_gap(spark, second, n):
    df = spark.createDataFrame([("e1", "2024-01-01 00:00:00"), ("e2", f"2024-01-01 {second}")], "event_id string, t string").selectExpr(
        "event_id", "cast(t as timestamp) created", "'i' invoice_id", "'s' subscription_id", "'invoice.paid' event_type", "'x' billing_reason", "1L amount_cents")
    assert C.bursts(df, MOBILE).count() == n


@pytest.mark.parametrize("n,kept", [(29, 0), (30, 1)])
def test_app_step_floor(spark, n, kept):
    mx = spark.range(n).selectExpr("'a' app_id", "1L step_k", "9.0D weeks_obs", "1L survived")
    assert H.app_step_rates(mx, MOBILE).count() == kept


@pytest.mark.parametrize("n,cat", [(249, "other"), (250, "x")])
def test_rare_category_floor(spark, n, cat):
    cells = spark.createDataFrame([("x", 1, n, n // 2), ("y", 1, 5000, 2500)], "geo string, step_k long, n long, died long")
    h = spark.createDataFrame([(1, 0.5)], "step_k long, h double")
    got = {r["raw"]: r["cat"] for r in H.residual_multipliers(cells, h, WEB, levers=["geo"]).collect()}
    assert got["x"] == cat and got["y"] == "y"


def test_url_names(spark, rows):
    vals = ["a%3Ab", "a:b", "x+y", "50%zz%3A", "%7Bad_name%7D", "{{ad.name}}", "ad_name", " Unknown ", "%7B", None, "ok"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [r["n"] for r in rows(df.select("i", url_dim("v", "ad_name").alias("n")), "i")]
    assert got == ["a:b", "a:b", "x+y", "50%zz:"] + ["(missing)"] * 6 + ["ok"]


def test_first_non_null_value(spark, rows):
    df = spark.sql("select * from values ('a', timestamp'2024-01-01', 1L, null, 'x'), ('a', timestamp'2024-01-02', 2L, 'g', 'y') t(sub_id, ts, tie, geo, app)")
    assert rows(L.first_values(df, "sub_id", ["geo", "app"]))[0] == {"sub_id": "a", "geo": "g", "app": "x"}


def test_clip_keeps_null(spark, rows):
    df = spark.sql("select * from values (1, null), (2, 0.1D), (3, 9.0D) t(i, v)")
    assert [r["c"] for r in rows(df.select("i", clip("v", 0.4, 2.5).alias("c")), "i")] == [None, 0.4, 2.5]


def test_sample_grades(spark, rows):
    df = spark.createDataFrame([(29,), (30,), (99,), (100,), (299,), (300,)], "n int")
    assert [r["g"] for r in rows(df.select("n", V.sample_grade("n").alias("g")), "n")] == ["insufficient", "rough", "rough", "directional", "directional", "reliable"]


def test_interval_words(spark, rows):
    df = spark.createDataFrame([(0, "Annual pass"), (1, "monthly"), (2, "1 week"), (3, "Daily"), (4, "x")], "i int, n string")
    assert [r["w"] for r in rows(df.select("i", interval_word("n").alias("w")), "i")] == ["year", "month", "week", "day", None]


def test_grace_entry_edges(spark, rows):
    df = spark.createDataFrame([("s", f"2024-01-0{i}", st, i) for i, st in enumerate(["active", "redemption", "redemption", "active", "redemption"], 1)], "subscription_id string, t string, status string, event_id long")
    df = df.selectExpr("subscription_id", "cast(t as timestamp) created", "status", "event_id", "'u' event_type")
    assert [r["event_datetime"].day for r in rows(C.entry_edges(df, MOBILE), "event_datetime")] == [2, 5]


def test_trial_kinds_by_gross(spark, rows):
    from tenurekit.functions.exprs import trial_kind
    df = spark.createDataFrame([(0, None), (1, 0.0), (2, 1.0), (3, 0.99)], "i int, a double").withColumn("e", F.lit("trial_started"))
    assert [r["k"] for r in rows(df.select("i", trial_kind("e", "a", "trial_started", 1.0).alias("k")), "i")] == ["free", "free", "placeholder", "real"]
