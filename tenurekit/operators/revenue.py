"""Money: base/upsell split, refunds, net revenue, cumulative revenue by period of life."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurekit.functions.exprs import clip, period_of_life, trial_kind
from tenurekit.functions.ordered import Ordered
from tenurekit.params import Params

# Event names that carry captured money.
PAID = ("trial_converted", "subscription_renewed")
REFUND = "subscription_refunded"
BASE, UPSELL, TRIAL = "subscription_started", "upsale_converted", "trial_started"


# ------------------------------------------------------------- subscription log (refunds known)
def split_base_ups(paid: DataFrame, price: float, amount: str = "price_amount") -> DataFrame:
    """Renewals: the plan price is base, the rest upsell. Trial conversions: all upsell."""
    base = F.when(F.col("event_name") == "trial_converted", F.lit(0.0)).otherwise(
        F.when(F.col(amount) > price, F.lit(price)).otherwise(F.col(amount)))
    return paid.withColumn("base_amt", base).withColumn("ups_amt", F.col(amount) - F.col("base_amt"))


def paid_events(events: DataFrame, price: float) -> DataFrame:
    return split_base_ups(events.where(F.col("event_name").isin(*PAID)), price)


def dedup_refunds(events: DataFrame) -> DataFrame:
    """One refund per subscription, amount and calendar day: the earliest."""
    first = F.min(F.struct("event_datetime", "tie", "customer_user_id"))
    r = events.where(F.col("event_name") == REFUND).groupBy(
        "subscription_id", "price_amount", F.to_date("event_datetime").alias("ev_date")).agg(first.alias("f"))
    return r.select("subscription_id", "price_amount", "ev_date", "f.*")


def net_by_subscription(events: DataFrame, price: float) -> DataFrame:
    """Net revenue per paying subscription: refunds capped at payments, taken off base and upsell in
    proportion, never below zero."""
    pay = paid_events(events, price).groupBy("subscription_id").agg(
        F.sum("base_amt").alias("base_payments"), F.sum("ups_amt").alias("ups_payments"),
        F.sum("price_amount").alias("total_payments"),
        F.min_by("customer_user_id", F.when(F.col("customer_user_id").isNotNull(), F.struct("event_datetime", "tie"))).alias("customer_user_id"))
    ref = dedup_refunds(events).groupBy("subscription_id").agg(F.sum("price_amount").alias("refund_total"))
    s = pay.join(ref, "subscription_id", "left").withColumn("refund_total", F.coalesce("refund_total", F.lit(0.0)))
    total = F.col("total_payments")
    s = s.withColumn("refund_capped", F.least("refund_total", total))
    s = s.withColumn("_share", F.when(total > 0, F.try_divide("base_payments", total)).otherwise(0.0))
    s = s.withColumn("base_net", clip(F.col("base_payments") - F.col("refund_capped") * F.col("_share"), 0.0))
    s = s.withColumn("ups_net", clip(F.col("ups_payments") - F.col("refund_capped") * (1 - F.col("_share")), 0.0))
    return s.withColumn("net_revenue", F.col("base_net") + F.col("ups_net")).drop("_share")


def net_events(events: DataFrame, price: float, p: Params, slices: int | None = None) -> DataFrame:
    """Net money per event in time order; a refund never takes more than what is left.

    The money left after each event is the running sum lifted by its lowest point below zero. A
    refund scales base and upsell alike: the base left is an affine fold, of which a payment is the
    term and a refund the factor."""
    pay = paid_events(events, price).select(
        "subscription_id", "customer_user_id", "event_datetime", "tie", "base_amt", "ups_amt",
        F.col("price_amount").alias("amt"), F.lit(0).alias("rank"))
    ref = dedup_refunds(events).select(
        "subscription_id", "customer_user_id", "event_datetime", "tie", F.lit(0.0).alias("base_amt"),
        F.lit(0.0).alias("ups_amt"), F.col("price_amount").alias("amt"), F.lit(1).alias("rank"))
    scan = Ordered(["subscription_id"], "event_datetime", ["rank", "tie", "amt"], slices=slices)
    is_ref = F.col("rank") == 1
    change = F.when(is_ref, -F.col("amt")).otherwise(F.col("amt"))
    ev = scan.open(pay.unionByName(ref))
    ev = scan.add(ev, running_sum={"_s": change})
    ev = scan.add(ev, running_min={"_m": F.col("_s"), "_mb": F.col("_s") - change})
    ev = ev.withColumn("_left", F.col("_s") - F.least(F.lit(0.0), F.col("_m")))
    ev = ev.withColumn("_was", F.greatest(F.col("_s") - change - F.least(F.lit(0.0), F.col("_mb")), F.lit(0.0)))
    kept = F.when(is_ref, F.when(F.col("_was") > 0, clip(F.try_divide("_left", "_was"), 0.0, 1.0)).otherwise(0.0)).otherwise(1.0)
    ev = scan.close(scan.add_affine(ev, "_base", kept, F.col("base_amt"), before="_base_was"))
    taken = F.col("_was") - F.col("_left")
    share = F.when(F.col("_was") > 0, clip(F.try_divide("_base_was", "_was"), 0.0, 1.0)).otherwise(0.0)
    return ev.select(
        "subscription_id", "customer_user_id", "event_datetime", "tie",
        F.when(is_ref, "refund").otherwise("pay").alias("kind"),
        F.when(is_ref, -taken * share).otherwise(F.col("base_amt")).alias("base_net_ev"),
        F.when(is_ref, -taken * (1 - share)).otherwise(F.col("ups_amt")).alias("ups_net_ev"))


def signed_events(events: DataFrame) -> DataFrame:
    """Payments plus, every refund row minus; neither deduplicated nor capped."""
    sign = F.when(F.col("event_name") == REFUND, -F.col("price_amount")).otherwise(F.col("price_amount"))
    return events.where(F.col("event_name").isin(*PAID, REFUND)).withColumn("revenue", sign)


# ------------------------------------------------------------- web log (net amounts known)
def session_id(grain: str) -> Column:
    """Key of everything downstream: the person, or the person's subscription."""
    if grain == "person":
        return F.col("email")
    if grain == "subscription":
        return F.concat(F.col("email"), F.lit("|"), F.col("subscription_key"))
    raise ValueError(f"grain must be person or subscription, not {grain}")


def out_of_scope(events: DataFrame, p: Params) -> DataFrame:
    """People of the other product, told by the list price of a trial or plan."""
    a = F.round("amt", 2)
    hit = ((F.col("event_type") == TRIAL) & (a == p.product_b_trial)) | (
        (F.col("event_type") == BASE) & (a >= p.product_b_base_min))
    return events.where(hit & F.col("email").isNotNull()).select("email").distinct()


def load_events(raw: DataFrame, p: Params, grain: str = "person", exclude: bool = True) -> DataFrame:
    """Normalised web log: lower-case key, net floored at zero, session key, trial kind, scope.
    A row without a session key stops the job rather than merging unrelated payments."""
    ev = raw.withColumn("email", F.lower("email")).withColumn("amt_net", clip("amt_net", 0.0))
    key = session_id(grain)
    ev = ev.withColumn("session_id", F.when(key.isNotNull(), key).otherwise(
        F.raise_error(F.lit("event without a session key")).cast("string")))
    ev = ev.withColumn("trial_kind", trial_kind("event_type", "amt", TRIAL, p.trial_placeholder))
    return ev.join(out_of_scope(ev, p), "email", "left_anti") if exclude else ev


def net_coverage(events: DataFrame, p: Params, by: Sequence[str] = ()) -> DataFrame:
    """Share of captured gross that has no net value, and whether it is tolerable."""
    e = events.where(F.col("event_type").isin(BASE, UPSELL, TRIAL) & (F.col("amt") > 0))
    lost = F.col("amt_net").isNull()
    out = e.groupBy(*by).agg(
        F.sum("amt").alias("gross"), F.coalesce(F.sum(F.when(lost, F.col("amt"))), F.lit(0.0)).alias("lost"),
        F.count_if(lost).alias("n_lost"), F.min(F.when(lost, F.to_date("ts"))).alias("lost_from"),
        F.max(F.when(lost, F.to_date("ts"))).alias("lost_to"))
    return out.withColumn("share", F.col("lost") / F.col("gross")).withColumn("ok", F.col("share") <= p.net_missing_max)


def money_events(events: DataFrame) -> DataFrame:
    """Rows with captured money: no state events, no placeholder or free trials."""
    dry = (F.col("event_type") == TRIAL) & F.coalesce(F.col("trial_kind").isin("placeholder", "free"), F.lit(False))
    return events.where(F.col("event_type").isin(BASE, UPSELL, TRIAL) & ~dry)


def revenue_by_key(events: DataFrame, p: Params, until: Column | None = None) -> DataFrame:
    """Trial, base and upsell net per key with flags, optionally as known at a time."""
    m = money_events(events)
    if until is not None:
        m = m.where(F.col("ts") <= until)
    net = F.coalesce("amt_net", F.lit(0.0))

    def stream(t):
        return F.sum(F.when(F.col("event_type") == t, net).otherwise(0.0))

    g = m.groupBy("email", "session_id").agg(
        stream(TRIAL).alias("trial_recv"), stream(BASE).alias("base_recv"), stream(UPSELL).alias("ups_recv"))
    for s in ("trial", "base", "ups"):
        g = g.withColumn(f"{s}_net", F.col(f"{s}_recv") * F.lit(1.0 - p.haircut))
    g = g.withColumn("total_net", F.col("trial_net") + F.col("base_net") + F.col("ups_net"))
    return g.select("email", "session_id", "trial_net", "base_net", "ups_net", "total_net",
                    (F.col("total_net") > 0).alias("is_payer"), (F.col("ups_recv") > 0).alias("has_ups"),
                    (F.col("trial_recv") > 0).alias("has_paid_trial"))


def weekly_net(events: DataFrame, pop: DataFrame, p: Params, keep: Sequence[str] = ("session_id",),
               streams: Sequence[str] | None = None) -> DataFrame:
    """Net revenue per `keep` columns of the population and period of life."""
    m = money_events(events)
    if streams is not None:
        m = m.where(F.col("event_type").isin(*streams))
    j = m.select("session_id", "ts", "amt_net", "event_type").join(
        pop.select("session_id", "first_date", *[c for c in keep if c != "session_id"]), "session_id")
    net = F.coalesce("amt_net", F.lit(0.0)) * F.lit(1.0 - p.haircut)
    return j.groupBy(*keep, period_of_life("first_date", "ts", p.period_days).alias("week")).agg(
        F.sum(net).alias("net"), F.sum(F.when(F.col("event_type") == BASE, net).otherwise(0.0)).alias("net_base"))


def cumulative_by_week(events: DataFrame, pop: DataFrame, p: Params, max_week: int,
                       streams: Sequence[str] | None = None) -> DataFrame:
    """Cumulative net per key and week 0..max_week, members without revenue included.

    The grid is one row per key and week; the running sum is bounded by max_week rows per key."""
    wk = weekly_net(events, pop, p, streams=streams).where(F.col("week") <= max_week)
    weeks = F.sequence(F.lit(0).cast("bigint"), F.lit(max_week).cast("bigint"))
    full = pop.select("session_id", F.explode(weeks).alias("week"))
    scan = Ordered(["session_id"], "week")
    return scan.add(full.join(wk, ["session_id", "week"], "left"),
                    running_sum={"cum": F.coalesce("net", F.lit(0.0))}).select("session_id", "week", "cum")


def person_rollup(sub_net: DataFrame, identity: DataFrame, members: DataFrame) -> DataFrame:
    """Subscription revenue summed to people through the identity map; members without any get zero."""
    per = sub_net.join(identity, "customer_user_id").groupBy("email").agg(F.sum("net_revenue").alias("total"))
    return members.join(per, "email", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def refund_rate(events: DataFrame) -> DataFrame:
    g = F.sum(F.when(F.col("event_name").isin(*PAID), F.col("price_amount")))
    r = F.sum(F.when(F.col("event_name") == REFUND, F.col("price_amount")))
    return events.agg(g.alias("gross"), r.alias("refunds")).withColumn("rate", F.col("refunds") / F.col("gross"))
