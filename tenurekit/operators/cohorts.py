"""Cohort facts: starts, plan prices, numbered payments, per-payment tables, averaged curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.functions.exprs import days_between, near, whole_days
from tenurekit.functions.ordered import Ordered, cut
from tenurekit.operators.survival import compress, direct_survival, grid
from tenurekit.params import Params

UPTO = (Window.unboundedPreceding, Window.currentRow)


def subscription_starts(events: DataFrame, start_event: str, key: str = "sub_id") -> DataFrame:
    """Earliest start event, else earliest event, with its source."""
    g = events.groupBy(key).agg(
        F.min(F.when(F.col("event_name") == start_event, F.col("ts"))).alias("_s"), F.min("ts").alias("_f"))
    return g.select(key, F.coalesce("_s", "_f").alias("start_ts"),
                    F.when(F.col("_s").isNotNull(), start_event).otherwise("first_local_event").alias("start_source"))


def price_cohort(events: DataFrame, starts: DataFrame, price: float, tol: float, floor: float,
                 key: str = "sub_id", price_id: str | None = None, target_id: str | None = None) -> DataFrame:
    """Who is on the plan: by exact price id when the log has one, else by the most frequent full
    amount (smallest on ties). Amounts are counted per value before the mode is taken."""
    keys = starts.select(key)
    if price_id is not None and price_id in events.columns:
        hit = events.where(F.col(price_id) == target_id).select(key).distinct().withColumn("_h", F.lit(True))
        out = keys.join(hit, key, "left")
        inside = F.coalesce("_h", F.lit(False))
        return out.select(key, F.lit(None).cast("double").alias("inferred_price"), inside.alias("in_price_cohort"),
                          F.lit(f"exact:{price_id}").alias("reason"))
    amt = events.where("amount > 0").join(keys, key, "left_semi").groupBy(
        key, F.round("amount", 2).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    per = amt.groupBy(key).agg(
        F.min_by("a", F.when(F.col("a") >= floor, F.struct(-F.col("n"), F.col("a")))).alias("inferred_price"))
    out = keys.join(per.withColumn("_any", F.lit(True)), key, "left")
    known = F.col("inferred_price").isNotNull()
    reason = (F.when(known, "mode_of_full_amounts").when(F.col("_any"), "low_amount_only_unknown_plan")
              .otherwise("no_local_price"))
    inside = F.coalesce(near("inferred_price", price, tol), F.lit(False))
    return out.select(key, "inferred_price", inside.alias("in_price_cohort"), reason.alias("reason"))


def numbered_payments(events: DataFrame, paid: Sequence[str], price: float, tol: float, p: Params,
                      until: Column | None = None, key: str = "sub_id", event_id: str | None = None) -> DataFrame:
    """Payments at the plan price in order, numbered from 0; duplicates are dropped by event id when
    the log has one, else by (key, time, name, amount), keeping the earliest."""
    e = events.where(F.col("event_name").isin(*paid) & near("amount", price, tol))
    if until is not None:
        e = e.where(F.col("ts") <= until)
    if event_id is not None and event_id in e.columns:
        # one row per id: the earliest; ids are unique enough that no group grows with the data
        e = e.groupBy(event_id).agg(F.min(F.struct("ts", "tie", key, "event_name", "amount")).alias("r")).select("r.*")
    else:
        e = e.groupBy(key, "ts", "event_name", "amount").agg(F.min("tie").alias("tie"))
    scan = Ordered([key], "ts", ["tie"])
    return scan.add(e, row_no="payment_number").withColumn("rebill_number", F.col("payment_number") - 1)


def cohort_facts(numbered: DataFrame, members: DataFrame, now: Column, p: Params, key: str = "sub_id") -> DataFrame:
    """Per cohort and rebill: active payers, revenue, retention, ARPU and cumulative value on the
    fixed number of first payers, up to the cohort's maturity (age less two periods).

    members: key, cohort (a date)."""
    j = numbered.join(members.select(key, "cohort"), key)
    # a few rows, read three times; written, so that payments are numbered once
    per = cut(j.groupBy("cohort", "rebill_number").agg(F.count(F.lit(1)).alias("active_users"), F.sum("amount").alias("revenue")))
    age = F.floor(whole_days(F.col("cohort").cast("timestamp"), now) / F.lit(float(p.period_days)))
    size = per.groupBy("cohort").agg(
        F.max(F.when(F.col("rebill_number") == 0, F.col("active_users"))).alias("payers"),
        F.max("rebill_number").alias("_present"))
    size = size.withColumn("age", age).withColumn("max_mature", F.greatest(F.lit(0).cast("bigint"), F.col("age") - 2))
    g = grid(size, "rebill_number", 0, F.least(F.col("_present"), F.col("max_mature")))
    g = g.join(per, ["cohort", "rebill_number"], "left").fillna(0, ["active_users"]).fillna(0.0, ["revenue"])
    w = Window.partitionBy("cohort").orderBy("rebill_number").rowsBetween(*UPTO)
    cum = F.sum("revenue").over(w)
    return g.select(
        "cohort", "rebill_number", "payers", "max_mature", "active_users", "revenue",
        (F.col("active_users") / F.col("payers")).alias("rebill_percent"),
        F.try_divide("revenue", "active_users").alias("arpu_at_payment"), cum.alias("cumulative_revenue"),
        (cum / F.col("payers")).alias("payer_ltv"))


def fact_totals(facts: DataFrame, anchor: int = 3) -> DataFrame:
    """Totals of the cohort facts in long form: first payers, payments, revenue, value per payer at the anchor rebill (if reached)."""
    last = F.max_by("cumulative_revenue", "rebill_number")
    at = F.max(F.when(F.col("rebill_number") == anchor, F.col("payer_ltv")))
    g = facts.groupBy("cohort").agg(F.max("payers").alias("payers"), F.sum("active_users").alias("payments"), last.alias("revenue"), at.alias("anchor"))
    return _long(g)


def payment_totals(numbered: DataFrame, members: DataFrame, now: Column, p: Params, anchor: int = 3, key: str = "sub_id") -> DataFrame:
    """The same totals straight from the payments of each key, without facts, grids or running sums."""
    age = F.floor(whole_days(F.col("cohort").cast("timestamp"), now) / F.lit(float(p.period_days)))
    j = numbered.join(members.select(key, "cohort"), key).where(F.col("rebill_number") <= F.greatest(F.lit(0).cast("bigint"), age - 2))
    per = j.groupBy("cohort", key).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("m"), F.max("rebill_number").alias("last"),
                                       F.sum(F.when(F.col("rebill_number") <= anchor, F.col("amount"))).alias("to_anchor"))
    g = per.groupBy("cohort").agg(F.count(F.lit(1)).alias("payers"), F.sum("n").alias("payments"), F.sum("m").alias("revenue"),
                                  F.when(F.max("last") >= anchor, F.sum("to_anchor") / F.count(F.lit(1))).alias("anchor"))
    return _long(g)


def _long(totals: DataFrame) -> DataFrame:
    names = ("payers", "payments", "revenue", "anchor")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))
    return totals.select("cohort", each.alias("_m")).select("cohort", "_m.*").where("value is not null")


def admitted(facts: DataFrame, min_payers: int = 15, min_mature: int = 3) -> DataFrame:
    """Facts of cohorts with enough first payers and enough mature rebills."""
    return facts.where((F.col("payers") >= min_payers) & (F.col("max_mature") >= min_mature))


def coverage(starts: DataFrame, plan: DataFrame, numbered: DataFrame, matrix_keys: DataFrame, key: str = "sub_id") -> DataFrame:
    """Membership flags of every started subscription."""
    first = numbered.where("rebill_number = 0").select(key).distinct().withColumn("_f", F.lit(True))
    mx = matrix_keys.select(key).distinct().withColumn("_m", F.lit(True))
    out = starts.select(key).join(plan.select(key, "in_price_cohort"), key, "left").join(first, key, "left").join(mx, key, "left")
    return out.select(key, F.coalesce("in_price_cohort", F.lit(False)).alias("in_price_cohort"),
                      F.coalesce("_f", F.lit(False)).alias("is_first_payer"),
                      F.coalesce("_m", F.lit(False)).alias("in_matrix"))


def coverage_summary(flags: DataFrame) -> DataFrame:
    payer = F.col("is_first_payer") & F.col("in_price_cohort")
    both = payer & F.col("in_matrix")
    return flags.agg(F.count(F.lit(1)).alias("starts"), F.count_if("in_price_cohort").alias("on_plan"),
                     F.count_if(payer).alias("first_payers"), F.count_if(both).alias("in_matrix"),
                     F.count_if(payer & ~F.col("in_matrix")).alias("missing")).withColumns({
                         "first_pay_rate": F.try_divide("first_payers", "on_plan"),
                         "matrix_coverage": F.try_divide("in_matrix", "first_payers")})


def arpu_by_step(mx: DataFrame, payments: DataFrame, hmax: int, key: str = "sub_id") -> DataFrame:
    """Mean amount per step, matched on key and exact time; steps beyond the data keep the last mean."""
    pay = payments.groupBy(key, F.col("ts").alias("pay_ts")).agg(F.avg("amount").alias("amount"), F.count(F.lit(1)).alias("copies"))
    m = mx.join(pay, [key, "pay_ts"], "left").groupBy("step_k").agg(F.avg("amount").alias("arpu"), F.count("amount").alias("n"))
    steps = m.sparkSession.range(1, hmax + 1).withColumnRenamed("id", "step_k")
    w = Window.partitionBy(F.lit(0)).orderBy("step_k").rowsBetween(*UPTO)
    return steps.join(m, "step_k", "left").select("step_k", F.last("arpu", True).over(w).alias("arpu"), F.coalesce("n", F.lit(0)).alias("n"))


def payment_funnel(mx: DataFrame, arpu: DataFrame, p: Params) -> DataFrame:
    """Per step: paid at it, at least and exactly that often, share among mature keys, and value."""
    counts = compress(mx.withColumn("_g", F.lit(1)), ["_g"])
    g = grid(counts, "k", 1, p.hmax)
    old, n = F.col("age") >= F.col("k"), F.col("n")

    def total(cond):
        return F.sum(F.when(cond, n).otherwise(0))

    f = g.groupBy("k").agg(
        total(old).alias("n_mature"), total(old & (F.col("max_step") >= F.col("k"))).alias("paid_at_step"),
        total(F.col("max_step") >= F.col("k")).alias("paid_at_least"), total(F.col("max_step") == F.col("k")).alias("paid_exactly"))
    s = direct_survival(mx.withColumn("_g", F.lit(1)), p, ["_g"]).select("k", F.col("fact").alias("survival"))
    f = f.join(s, "k").join(arpu.select(F.col("step_k").alias("k"), "arpu"), "k", "left")
    f = f.withColumn("paid_share", F.try_divide("paid_at_step", "n_mature")).withColumn("increment", F.col("survival") * F.col("arpu"))
    w = Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(*UPTO)
    return f.withColumn("cumulative", F.sum("increment").over(w))


def payment_distribution(mx: DataFrame, weeks: int) -> DataFrame:
    """Number of payments made through each week among keys mature at it, in long form."""
    g = grid(compress(mx.withColumn("_g", F.lit(1)), ["_g"]), "week", 1, F.least(F.col("age"), F.lit(weeks).cast("bigint")))
    return g.groupBy("week", F.least("max_step", "week").alias("payments")).agg(F.sum("n").alias("n"))


def averaged_curve(subs: DataFrame, payments: DataFrame, now: Column, p: Params, max_week: int, by: Sequence[str] = (),
                   key: str = "sub_id") -> DataFrame:
    """Mean cumulative amount by period of life over keys that ever paid and have lived the period
    through. Money is summed per (age, period) first; only these sums are laid over the grid.

    subs: key, start_ts, by. payments: key, ts, amount."""
    day = float(p.period_days)
    s = subs.select(key, "start_ts", *by, F.floor(days_between(F.col("start_ts"), now) / day).alias("age"))
    wk = F.greatest(F.floor(days_between("start_ts", "ts") / day), F.lit(0).cast("bigint"))
    j = payments.select(key, "ts", "amount").join(s, key).withColumn("u", wk)
    payers = j.groupBy(*by, "age", key).agg(F.lit(1).alias("_1")).groupBy(*by, "age").agg(F.count(F.lit(1)).alias("n"))
    money = j.where(F.col("u") <= max_week).groupBy(*by, "age", "u").agg(F.sum("amount").alias("m"))
    top = F.lit(max_week).cast("bigint")
    n = grid(payers.where("age >= 1"), "week", 0, F.least(F.col("age") - 1, top)).groupBy(*by, "week").agg(F.sum("n").alias("n"))
    m = grid(money.where("age >= 1"), "week", F.col("u"), F.least(F.col("age") - 1, top)).groupBy(*by, "week").agg(F.sum("m").alias("m"))
    out = n.join(m, [*by, "week"], "left")
    return out.select(*by, "week", "n", (F.coalesce("m", F.lit(0.0)) / F.col("n")).alias("cum_avg"))


def last_reliable_week(curve: DataFrame, min_n: int, by: Sequence[str] = ()) -> DataFrame:
    g = curve.groupBy(*by).agg(F.max(F.when(F.col("n") >= min_n, F.col("week"))).alias("_r"), F.max("week").alias("_m"))
    return g.select(*by, F.coalesce("_r", "_m").alias("last_week"))


def pooled_curve(facts: DataFrame, value: str = "payer_ltv") -> DataFrame:
    """Payer-weighted mean of a cohort fact over cohorts mature at each rebill."""
    return facts.groupBy("rebill_number").agg(
        (F.sum(F.col(value) * F.col("payers")) / F.sum("payers")).alias(value),
        F.count(F.lit(1)).alias("cohorts"))
