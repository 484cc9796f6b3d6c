"""Sliced scans give the rows of plain windows, whatever key, day or instant holds most rows."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tenurekit.functions.ordered import Ordered
from tenurekit.operators import ladder as L
from tenurekit.operators import quality as Z
from tenurekit.params import USERS


@pytest.fixture(scope="module")
def skewed(spark):
    r = random.Random(7)
    data = []
    for i in range(900):
        key = 0 if i % 3 == 0 else r.randrange(1, 40)
        data.append((key, f"2024-01-{r.randrange(1, 29):02d} {r.randrange(24):02d}:{r.choice(['00', '30'])}:00", r.choice(["pay", "pay", "issue", "vol", "other"]), float(r.randrange(1, 50)), i))
    df = spark.createDataFrame(data, "sub_id long, t string, kind string, amount double, tie long")
    return df.selectExpr("sub_id", "cast(t as timestamp) ts", "kind", "amount", "tie", "case when kind = 'pay' then 'subscription_renewed' else 'x' end event_name")


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


def columns(o):
    return dict(prev={"p": F.col("ts"), "pn": F.when(F.col("kind") == "pay", F.col("amount"))}, next={"n": F.col("tie")},
                last_before={"lb": F.when(F.col("kind") == "issue", F.col("tie"))}, running_sum={"s": F.col("amount"), "sn": F.when(F.col("kind") == "vol", 1)},
                running_min={"m": -F.col("amount")}, row_no="rn")


def windows(df):
    """The same columns by plain windows."""
    w = Window.partitionBy("sub_id").orderBy("ts", "tie")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    pay, issue, vol = (F.col("kind") == k for k in ("pay", "issue", "vol"))
    return df.withColumns({
        "p": F.lag("ts").over(w), "pn": F.lag(F.when(pay, F.col("amount"))).over(w), "n": F.lead("tie").over(w),
        "lb": F.last(F.when(issue, F.col("tie")), ignorenulls=True).over(before), "s": F.sum("amount").over(upto),
        "sn": F.sum(F.when(vol, 1)).over(upto), "rn": F.row_number().over(w).cast("bigint"), "m": F.min(-F.col("amount")).over(upto)})


@pytest.mark.parametrize("slices", [1, 7, 40])
def test_every_kind_of_column(skewed, slices):
    odd = skewed.withColumns({
        "sub_id": F.when(F.col("sub_id") != 5, F.col("sub_id")),  # a null key
        "ts": F.when(F.col("sub_id") == 0, F.timestamp_seconds(F.lit(1_704_067_200)))  # a third of all rows at one instant
        .when(F.col("tie") % 11 != 0, F.col("ts"))})  # null times
    for df in (skewed, odd):
        o = Ordered(["sub_id"], "ts", ["tie"], slices=slices)
        same(o.add(df, **columns(o)), windows(df))


def test_null_keys_keep_their_sums(spark):
    df = spark.createDataFrame([(None, 1, 5.0), (None, 2, 6.0), (None, 3, 7.0)], "k long, t long, v double")
    for slices in (1, 2, 3):
        got = Ordered(["k"], "t", slices=slices).add(df, running_sum={"s": F.col("v")}, prev={"p": F.col("v")}).orderBy("t").collect()
        assert [(r.s, r.p) for r in got] == [(5.0, None), (11.0, 5.0), (18.0, 6.0)]


def test_a_hot_instant_is_split(spark):
    df = spark.range(3000).select(F.lit(1).alias("k"), F.lit(0).alias("t"), F.col("id").alias("tie"))
    dealt = Ordered(["k"], "t", ["tie"], slices=10).open(df).groupBy("_slice").count().collect()
    assert len(dealt) > 5 and max(r["count"] for r in dealt) < 900


@pytest.mark.parametrize("slices", [1, 6])
def test_affine_fold(skewed, slices):
    data = sorted(map(tuple, skewed.select("sub_id", "ts", "tie", "amount").collect()))
    want, state = {}, {}
    for key, _, tie, amount in data:
        factor, term = (0.0, 1.0) if tie % 13 == 0 else (0.9, amount)
        want[tie] = state[key] = factor * state.get(key, 0.0) + term
    zero = F.col("tie") % 13 == 0
    o = Ordered(["sub_id"], "ts", ["tie"], slices=slices)
    got = o.add_affine(skewed, "x", F.when(zero, 0.0).otherwise(0.9), F.when(zero, 1.0).otherwise(F.col("amount")))
    assert {r.tie: r.x for r in got.collect()} == pytest.approx(want)
    assert got.columns == [*skewed.columns, "x"]


def test_nothing_runs_before_the_result_is_used(spark, skewed):
    tracker, ids = spark.sparkContext.statusTracker(), []
    spark.sparkContext.setJobGroup("building", "building")
    try:
        L.step_flags(skewed, USERS)
        L.payment_ladder(skewed.where("kind = 'pay'").select("sub_id", "ts", "tie"), USERS)
        ids = tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(ids) == []


@pytest.mark.parametrize("fn", [
    lambda e, p: L.step_flags(e, p), lambda e, p: L.payment_ladder(e.where("kind = 'pay'").select("sub_id", "ts", "tie"), p),
    lambda e, p: L.resubscribers(e, p, 2.0),
    lambda e, p: Z.long_pauses(e.where("kind = 'issue'"), e.where("kind = 'pay'"), p, 2.0, "sub_id"),
    lambda e, p: Z.late_success(e.where("kind = 'pay'"), e.where("kind = 'issue'"), p, 2.0, "sub_id"),
])
def test_operators_agree(skewed, fn, monkeypatch):
    monkeypatch.setattr(Ordered, "default_slices", 1)
    one = fn(skewed, USERS)
    monkeypatch.setattr(Ordered, "default_slices", 9)
    same(one, fn(skewed, USERS))


def test_cleaning_operators_agree(spark, monkeypatch):
    """Whole cleaning chain of both providers, plain and sliced."""
    from tenurekit.operators import clean as C
    from tenurekit.params import MOBILE
    from tenurekit.sources.adapters import sub_events, webhooks_a, webhooks_b

    d = "/root/testdata/sf0.001"
    a = C.parse_a(C.dedup_by_id(webhooks_a(spark, d))).cache()
    b = C.parse_b(C.dedup_exact(webhooks_b(spark, d))).cache()

    def chain(slices, p=MOBILE):
        monkeypatch.setattr(Ordered, "default_slices", slices)
        orders = C.order_outcomes(C.orders_b(b), p)
        return [C.invoice_outcomes(C.bursts(C.invoice_rows(a), p, 21600), p), orders, C.entry_edges(C.flat_b(b), p), C.cadence(orders, p),
                L.chain_outcome(sub_events(spark, d).withColumn("churn_type", F.lit("voluntary")).replace("vol", "end", "kind"), p)]

    for x, y in zip(chain(1), chain(11)):
        assert x.count() > 0
        same(x, y)
    a.unpersist()
    b.unpersist()


def test_net_events_agree_on_whole_tables(spark):
    from tenurekit.operators import revenue as R
    from tenurekit.params import MOBILE
    from tenurekit.sources.adapters import refund_events

    e = refund_events(spark, "/root/testdata/sf0.001")

    def run(slices):
        n = R.net_events(e, 20000.0, MOBILE, slices)
        return n.select("subscription_id", "tie", "kind", F.round("base_net_ev", 4).alias("b"), F.round("ups_net_ev", 4).alias("u")).collect()

    a, b = (sorted(map(tuple, run(n))) for n in (1, 9))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:3] == y[:3] and abs(x[3] - y[3]) < 1e-3 and abs(x[4] - y[4]) < 1e-3


def test_scans_of_a_ladder_share_one_shuffle_of_the_rows(spark, skewed):
    """No range shuffle, no summary row of a key that is one slice, and slices that stay as they are from scan to scan."""
    o = Ordered(["sub_id"], "ts", ["tie"], slices=4)
    dealt = o.open(skewed)
    found = {r["sub_id"]: r["n"] for r in dealt.groupBy("sub_id").agg(F.count_distinct("_slice").alias("n")).collect()}
    assert found.pop(0) > 1 and set(found.values()) == {1}  # the one key above a quarter of the rows is cut
    assert dealt.where("sub_id > 0 and _slice > 0").count() == 0
    first = o.add(dealt, row_no="a")
    assert "rangepartitioning" not in first._jdf.queryExecution().executedPlan().toString()
    second = o.add(first.where("kind <> 'other'"), row_no="b")
    w = Window.partitionBy("sub_id").orderBy("ts", "tie")
    want = skewed.withColumn("a", F.row_number().over(w).cast("bigint")).where("kind <> 'other'").withColumn("b", F.row_number().over(w).cast("bigint"))
    same(o.close(second), want)


def test_a_step_goes_on_in_later_slices(spark):
    """One payment, then states over many slices, then a second payment: flags and next payment are found across them."""
    data = [(1, 0, "pay", 0), *[(1, 1 + i // 9, "vol" if i == 250 else "issue" if i == 290 else "other", i + 1) for i in range(300)], (1, 60 * 86400, "pay", 999), (2, 5, "pay", 1000)]
    df = spark.createDataFrame(data, "sub_id long, s long, kind string, tie long").selectExpr("sub_id", "timestamp_seconds(s) ts", "kind", "tie")
    df = df.withColumn("kind", F.when((F.col("kind") == "other") & (F.col("tie") < 240), "issue").otherwise(F.col("kind")))
    for drop_issue in (False, True):
        d = df.where("kind <> 'issue'") if drop_issue else df
        got = []
        for slices in (1, 40):
            Ordered.default_slices = slices
            try:
                got.append(sorted(tuple(map(str, r)) for r in L.step_flags(d, USERS).select("sub_id", "step_k", "had_issue", "had_vol", "next_ts", "first_pay").collect()))
            finally:
                Ordered.default_slices = None
        assert got[0] == got[1] and [g[:4] for g in got[0]] == [("1", "1", str(not drop_issue), "True"), ("1", "2", "False", "False"), ("2", "1", "False", "False")]
