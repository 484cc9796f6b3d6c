"""Revenue cases; expected values are computed here from the amounts."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tenurekit.operators import population as N
from tenurekit.operators import revenue as R
from tenurekit.params import MOBILE

PRICE = 9.99


@pytest.fixture
def log(spark):
    def make(*rows):
        data = [(s, c, t, e, p, i) for i, (s, c, t, e, p) in enumerate(rows)]
        df = spark.createDataFrame(data, "subscription_id string, customer_user_id string, t string, event_name string, price_amount double, tie long")
        return df.selectExpr("subscription_id", "customer_user_id", "cast(t as timestamp) event_datetime", "event_name", "price_amount", "tie")

    return make


def day(n, hour=0):
    return str(datetime(2024, 3, 1) + timedelta(days=n, hours=hour))


def pays(*amounts, sub="k", every=5, name="subscription_renewed"):
    return [(sub, "owner", day(every * i), name, a) for i, a in enumerate(amounts)]


def refund(at, amount, sub="k", hour=0):
    return (sub, "owner", day(at, hour), "subscription_refunded", amount)


def fold(events):
    """Base and upsell per event by the plain rule, event after event."""
    base = ups = 0.0
    out = []
    for kind, b, u in events:
        if kind == "pay":
            step = (b, u)
        else:
            left = base + ups
            taken = min(b, left)
            step = (-taken * base / left, -taken * ups / left) if left > 0 else (0.0, 0.0)
        base, ups = base + step[0], ups + step[1]
        out.append(step)
    return out


def test_split_of_each_payment(log, rows):
    amounts = [3.25, 9.99, 10.0, 24.5, 0.0]
    g = log(*pays(*amounts), *pays(7.5, sub="t", name="trial_converted"))
    got = rows(R.paid_events(g, PRICE), "tie")
    assert [(r["base_amt"], round(r["ups_amt"], 6)) for r in got] == [(min(a, PRICE), round(max(0, a - PRICE), 6)) for a in amounts] + [(0.0, 7.5)]


def test_only_money_counts(log, rows):
    quiet = [("k", "owner", day(n), e, None) for n, e in enumerate(["trial_started", "billing_issue_detected", "subscription_cancelled"])]
    assert rows(R.net_by_subscription(log(*quiet), PRICE)) == []
    assert rows(R.net_by_subscription(log(*pays(4.0, 4.5), *quiet), PRICE))[0]["net_revenue"] == pytest.approx(8.5)


def test_refunds_of_a_day(log, rows):
    same_day = [refund(40, 6.0, hour=h) for h in (1, 2, 23)] + [refund(40, 2.5, hour=h) for h in (3, 4)]
    g = log(*pays(30.0), *same_day, refund(41, 6.0), refund(40, 6.0, sub="other"))
    got = rows(R.dedup_refunds(g), "subscription_id", "event_datetime", "price_amount")
    assert [(r["subscription_id"], r["price_amount"], str(r["event_datetime"])) for r in got] == [
        ("k", 6.0, day(40, 1)), ("k", 2.5, day(40, 3)), ("k", 6.0, day(41)), ("other", 6.0, day(40))]


@pytest.mark.parametrize("paid,back", [((30.0,), (4.0, 1.5)), ((12.0, 6.0, 15.0), (40.0, 2.0)), ((5.0,), (5.0,)), ((20.0, 20.0), ())])
def test_net_of_a_subscription(log, rows, paid, back):
    g = log(*pays(*paid), *[refund(60 + n, a) for n, a in enumerate(back)])
    r = rows(R.net_by_subscription(g, PRICE))[0]
    total, base = sum(paid), sum(min(a, PRICE) for a in paid)
    taken = min(sum(back), total)
    assert (r["total_payments"], r["refund_total"], r["refund_capped"]) == pytest.approx((total, sum(back), taken))
    assert (r["base_net"], r["ups_net"]) == pytest.approx((base * (1 - taken / total), (total - base) * (1 - taken / total)))
    assert r["net_revenue"] == pytest.approx(total - taken)


def net(log, rows, events, slices):
    got = rows(R.net_events(log(*events), PRICE, MOBILE, slices), "event_datetime", "kind", "tie")
    return [(r["base_net_ev"], r["ups_net_ev"]) for r in got]


@pytest.mark.parametrize("slices", [1, 4])
def test_refund_before_the_money_takes_nothing(log, rows, slices):
    events = [refund(-3, 8.0), *pays(25.0, 2.0), refund(7, 9.0), refund(8, 100.0), refund(9, 1.0), *[(s, c, day(12), e, a) for s, c, _, e, a in pays(14.0)]]
    want = fold([("refund", 8.0, 0), ("pay", PRICE, 25 - PRICE), ("pay", 2.0, 0), ("refund", 9.0, 0), ("refund", 100.0, 0), ("refund", 1.0, 0), ("pay", PRICE, 14 - PRICE)])
    got = net(log, rows, events, slices)
    assert [x for pair in got for x in pair] == pytest.approx([x for pair in want for x in pair])
    assert sum(map(sum, got)) == pytest.approx(14.0)


@pytest.mark.parametrize("slices", [1, 5])
def test_many_cycles_keep_their_digits(log, rows, slices):
    """Each payment but a sliver is given back, 140 times: a running product would leave the range of floats."""
    events, plain = [], []
    for n in range(140):
        events += [("k", "owner", day(n), "subscription_renewed", 10.0), refund(n, 9.9999, hour=6)]
        plain += [("pay", PRICE, 10.0 - PRICE), ("refund", 9.9999, 0)]
    want = fold(plain)
    got = net(log, rows, events, slices)
    assert len(got) == 280
    assert [x for pair in got for x in pair] == pytest.approx([x for pair in want for x in pair], abs=1e-6)


def test_money_before_refund_at_one_instant(log, rows):
    got = net(log, rows, [refund(2, 1.75), ("k", "owner", day(2), "subscription_renewed", 6.0)], None)
    assert [x for pair in got for x in pair] == pytest.approx([6.0, 0.0, -1.75, 0.0])


def test_funnel_class_is_decided_by_spelling(spark):
    """Every spelling of a missing name, in any case and padding that the rule folds, against the rule itself; listed names win over others."""
    listed = ["spring-sale", "partner/7"]
    names = [*listed, "autumn", "7", "nobody", *[f"{name}-{k}" for name in listed for k in range(3)]]
    f = spark.createDataFrame([(n,) for n in names], "f string")
    got = {r.f: r.c for r in f.select("f", N.funnel_class("f", listed).alias("c")).collect()}
    assert {n for n, c in got.items() if c == "whitelist"} == set(listed)
    assert {c for n, c in got.items() if n not in listed} == {"other"}
    missing = f.select(F.when(F.lit(True), F.lit(None).cast("string")).alias("f")).limit(1).select(N.funnel_class("f", listed).alias("c"))
    assert [r.c for r in missing.collect()] == ["organic"]


def test_a_payer_is_anyone_with_money_left(spark, rows):
    """Net totals of people who paid, gave back part, or gave back all: the second denominator counts the positive ones."""
    paid = [(f"person-{k}", 4.25 * (k % 5), 4.25 * (k % 5 if k % 3 else 0)) for k in range(30)]
    totals = [(name, gross - returned) for name, gross, returned in paid]
    p = spark.createDataFrame(totals, "e string, total_net double")
    assert rows(N.denominators(p)) == [{"n_attributed": len(paid), "n_payers": sum(net > 0 for _, net in totals)}]


def test_missing_session_key_stops_the_job(spark):
    e = spark.createDataFrame([("A@x", None, "subscription_started", 9.99, 9.0)], "email string, subscription_key string, event_type string, amt double, amt_net double")
    with pytest.raises(Exception, match="without a session key"):
        R.load_events(e, MOBILE, "subscription").collect()
