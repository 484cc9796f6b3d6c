"""Payment ladders: raw events to numbered steps with outcomes.

Events have sub_id, ts, tie (unique per row) and kind: pay, issue, vol or anything else. Step k is
the k-th payment kept after dropping payments too close to the previous raw payment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurekit.functions.exprs import days_between, periods_between, whole_days
from tenurekit.functions.ordered import Ordered
from tenurekit.functions.ranks import percentiles
from tenurekit.params import Params


def payment_ladder(pays: DataFrame, p: Params, key: str = "sub_id") -> DataFrame:
    """Kept payments with step_k, next_ts and days_to_next. A payment is dropped when the payment
    just before it, kept or not, is at most `dedup_days` older."""
    scan = Ordered([key], "ts", ["tie"])
    gap = scan.add(scan.open(pays), prev={"_prev_ts": F.col("ts")})
    kept = gap.where(F.col("_prev_ts").isNull() | (days_between("_prev_ts", "ts") > p.dedup_days)).drop("_prev_ts")
    out = scan.close(scan.add(kept, row_no="step_k", next={"next_ts": F.col("ts")}))
    return out.withColumn("days_to_next", days_between("ts", "next_ts"))


def step_flags(events: DataFrame, p: Params, key: str = "sub_id", carry: Sequence[str] = ()) -> DataFrame:
    """One row per kept payment with had_issue / had_vol: did such an event fall after the payment
    and up to the next one?

    Payments and state events run through one ordered scan; a state event belongs to the number of
    kept payments strictly before it, so one at the instant of a payment counts for the step before.
    """
    is_pay = F.col("kind") == "pay"
    ev = (events.where(F.col("kind").isin("pay", "issue", "vol"))
          .select(key, "ts", "tie", "kind", *carry)
          .withColumn("_rank", F.when(is_pay, 1).otherwise(0)))
    scan = Ordered([key], "ts", ["_rank", "tie"])
    ev = scan.add(scan.open(ev), last_before={"_prev_pay": F.when(is_pay, F.col("ts"))})
    kept = is_pay & (F.col("_prev_pay").isNull() | (days_between("_prev_pay", "ts") > p.dedup_days))
    ev = ev.withColumn("_kept", kept).where(~is_pay | F.col("_kept"))
    ev = scan.add(ev, running_sum={"step_k": F.col("_kept").cast("bigint")}).where("step_k >= 1")
    # a step has one kept payment; its columns one by one, since times and numbers are aggregated without a sort, structs are not
    pay_row = ["ts", "tie", *carry]
    flags = [F.col("kind") == "issue", F.col("kind") == "vol"]
    steps = ev.groupBy(key, "step_k", "_key", "_slice").agg(
        *[F.max(F.when(F.col("_kept"), F.col(c))).alias(c) for c in pay_row], F.coalesce(F.max("_kept"), F.lit(False)).alias("_paid"),
        F.max(flags[0]).alias("_issue"), F.max(flags[1]).alias("_vol"))
    # a step may go on in later slices of a key that was cut: at most one such row for each slice
    more = steps.where("_slice > 0 and not _paid").groupBy(F.struct(key, "step_k").alias("_step")).agg(
        F.max("_issue").alias("_issue_on"), F.max("_vol").alias("_vol_on")).persist(StorageLevel.DISK_ONLY)
    steps = steps.where("_paid").join(F.broadcast(more), F.struct(key, "step_k") == F.col("_step"), "left").select(
        key, "step_k", *[(F.col(c) | F.coalesce(f"{c}_on", F.lit(False))).alias(f"had{c}") for c in ("_issue", "_vol")], *pay_row, "_key", "_slice")
    out = scan.close(Ordered([key], "ts", ["tie"]).add(
        steps, next={"next_ts": F.col("ts")}, running_min={"first_pay": F.col("ts")}))
    return out.withColumn("days_to_next", days_between("ts", "next_ts"))


def outcome(p: Params, window: bool = True) -> Column:
    """Label of a step. Without `window` any later payment continues the chain and only a state
    event marks it recovered."""
    has_next = F.col("next_ts").isNotNull()
    late = F.lit(False)
    if window:
        has_next = has_next & (F.col("days_to_next") <= p.return_days)
        late = F.col("days_to_next") > p.late_days
    return (F.when(has_next & (F.col("had_issue") | late), "recovered").when(has_next, "renewed")
            .when(F.col("had_vol"), "voluntary_cancel").when(F.col("had_issue"), "billing_issue")
            .otherwise("churned"))


def chain_outcome(events: DataFrame, p: Params, key: str = "sub_id") -> DataFrame:
    """Outcome by position in the chain: recovered when an issue falls strictly between two
    payments; the last payment takes the churn type of a later terminal event, else it is alive.

    Events of kind pay, issue and end; end rows carry churn_type.
    """
    is_pay = F.col("kind") == "pay"
    ev = (events.where("kind in ('pay', 'issue')").select(key, "ts", "tie", "kind")
          .withColumn("_rank", F.when(is_pay, 1).otherwise(0)))
    scan = Ordered([key], "ts", ["_rank", "tie"])
    ev = scan.add(ev, running_sum={"step_k": is_pay.cast("bigint")}).where("step_k >= 1")
    steps = ev.groupBy(key, "step_k").agg(
        F.max(F.when(is_pay, F.struct("ts", "tie"))).alias("p"),
        F.min(F.when(~is_pay, F.col("ts"))).alias("first_issue")).select(key, "step_k", "first_issue", "p.*")
    steps = Ordered([key], "ts", ["tie"]).add(steps, next={"next_ts": F.col("ts")})
    last = events.where("kind = 'end'").groupBy(key).agg(
        F.max(F.struct("ts", "tie", "churn_type")).alias("t")).select(
        key, F.col("t.ts").alias("end_ts"), F.col("t.churn_type").alias("churn_type"))
    has_next = F.col("next_ts").isNotNull()
    ended = F.coalesce(F.col("end_ts") > F.col("ts"), F.lit(False))
    label = (F.when(has_next & F.coalesce(F.col("first_issue") < F.col("next_ts"), F.lit(False)), "recovered")
             .when(has_next | ~ended, "renewed").when(F.col("churn_type") == "voluntary", "voluntary_cancel")
             .when(F.col("churn_type") == "involuntary", "billing_issue").otherwise("churned"))
    return steps.join(last, key, "left").select(key, "step_k", "ts", "tie", "next_ts", label.alias("outcome"))


def first_values(events: DataFrame, key: str, cols: Sequence[str], order: Sequence[str] = ("ts", "tie")) -> DataFrame:
    """First non-null value of each column per key, in time order."""
    return events.groupBy(key).agg(*[first_value(c, order) for c in cols])


def first_value(c: str, order: Sequence[str] = ("ts", "tie")) -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c)


def plan_interval(steps: DataFrame, key: str = "sub_id", max_gap_days: float = 60.0) -> DataFrame:
    """Plan interval from the median gap between kept payments (gaps up to max_gap_days). Kept for
    the layout of the matrix; it follows from the outcome, so it is never a lever."""
    med = percentiles(steps.where(F.col("days_to_next") <= max_gap_days), "days_to_next", [0.5], [key])
    g = F.col("q0")
    word = (F.when((g >= 5) & (g <= 10), "week").when((g >= 25) & (g <= 35), "month")
            .when(g >= 350, "year").otherwise("unknown"))
    return med.select(key, word.alias("plan_interval"), g.alias("median_gap"))


def trial_days(events: DataFrame, trial_event: str, pay_event: str, key: str = "sub_id") -> DataFrame:
    """Whole days from the first trial to the first paying event."""
    t = events.groupBy(key).agg(
        F.min(F.when(F.col("event_name") == trial_event, F.col("ts"))).alias("t0"),
        F.min(F.when(F.col("event_name") == pay_event, F.col("ts"))).alias("p0"))
    return t.select(key, whole_days("t0", "p0").alias("trial_days"))


def snapshot(events: DataFrame, ts: str = "ts"):
    """Latest time of a log as a one-row subquery, not a driver-side value."""
    return events.agg(F.max(ts)).scalar()


def observation_age(events: DataFrame, p: Params, key: str = "sub_id", now: Column | None = None) -> DataFrame:
    """Periods a key has been observable: from the earliest given event to the snapshot. Pass all
    events (mobile), base payments (web) or a fixed `now` (golden) to choose the definition."""
    now = snapshot(events) if now is None else now
    first = events.groupBy(key).agg(F.min("ts").alias("first_ts"))
    return first.select(key, "first_ts", periods_between(F.col("first_ts"), now, p.period_days).alias("weeks_obs"))


def with_survival(mx: DataFrame) -> DataFrame:
    s = F.col("outcome").isin("renewed", "recovered").cast("bigint")
    return mx.withColumn("survived", s).withColumn("died", 1 - s)


MATRIX_COLUMNS = (
    "sub_id", "step_k", "state_from", "outcome", "weeks_obs", "pay_ts", "days_to_next", "app_id", "geo",
    "media_source", "attribution_source", "plan_interval", "trial_days", "cohort_month",
    "billing_day_of_month", "tie",
)


def mobile_matrix(events: DataFrame, p: Params) -> DataFrame:
    """Payment-step matrix of a mobile log: app, geo and media from the first event that has them,
    age from the first event of any kind."""
    steps = step_flags(events, p).withColumn("outcome", outcome(p)).persist(StorageLevel.DISK_ONLY)  # read by the matrix and the gaps
    # times of all rows are aggregated without a sort; first values, which need one, come from the rows that have any
    times = events.groupBy("sub_id").agg(
        F.min("ts").alias("first_ts"), F.min(F.when(F.col("event_name") == "trial_started", F.col("ts"))).alias("_t0"),
        F.min(F.when(F.col("event_name") == "subscription_renewed", F.col("ts"))).alias("_p0"))
    named = ("app_id", "geo", "media_source")
    attrs = times.join(first_values(events.where(F.coalesce(*named).isNotNull()), "sub_id", named), "sub_id", "left")
    attrs = attrs.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(none)")) for c in ("geo", "media_source")})
    attrs = attrs.withColumns({"trial_days": whole_days("_t0", "_p0"),
                               "weeks_obs": periods_between(F.col("first_ts"), snapshot(events), p.period_days)})
    attrs = attrs.join(plan_interval(steps).drop("median_gap"), "sub_id", "left")
    mx = steps.join(attrs, "sub_id").select(
        "sub_id", "step_k", F.lit("active").alias("state_from"), "outcome", "weeks_obs",
        F.col("ts").alias("pay_ts"), "days_to_next", "app_id", "geo", "media_source",
        F.lit("(none)").alias("attribution_source"),
        F.coalesce("plan_interval", F.lit("unknown")).alias("plan_interval"), "trial_days",
        F.date_format("first_ts", "yyyy-MM").alias("cohort_month"),
        F.dayofmonth("ts").cast("bigint").alias("billing_day_of_month"), "tie",
        F.dayofmonth("first_pay").cast("bigint").alias("first_billing_day"))
    return with_survival(mx)


def web_matrix(events: DataFrame, pop: DataFrame, p: Params, key: str = "session_id") -> DataFrame:
    """Payment-step matrix of a web log, restricted to the population: the cohort plays the app, age
    runs from the first base payment, and `evaluable` marks steps old enough to be judged."""
    members = events.join(pop.select(key), key, "left_semi").withColumn("kind", web_kind(p))
    now = snapshot(events)
    steps = step_flags(members, p, key).withColumn("outcome", outcome(p)).persist(StorageLevel.DISK_ONLY)  # read by the matrix and the gaps
    trial = members.where("event_type = 'trial_started'").groupBy(key).agg(F.min("ts").alias("first_trial"))
    attrs = (pop.join(trial, key, "left")
             .join(plan_interval(steps, key).drop("median_gap"), key, "left"))
    mx = steps.join(attrs, key).select(
        F.col(key).alias("sub_id"), "step_k", F.lit("active").alias("state_from"), "outcome",
        periods_between(F.col("first_pay"), now, p.period_days).alias("weeks_obs"),
        F.col("ts").alias("pay_ts"), "days_to_next", F.col("cohort_date").cast("string").alias("app_id"), "geo",
        F.col("utm_source").alias("media_source"), F.lit("(none)").alias("attribution_source"),
        F.coalesce("plan_interval", F.lit("unknown")).alias("plan_interval"),
        whole_days("first_trial", "first_pay").alias("trial_days"),
        F.date_format("cohort_date", "yyyy-MM").alias("cohort_month"),
        F.dayofmonth("ts").cast("bigint").alias("billing_day_of_month"), "tie",
        F.col("first_funnel").alias("funnel"),
        (whole_days(F.col("ts"), now) >= p.return_days).alias("evaluable"), "cohort_date", "utm_source",
        F.dayofmonth("first_pay").cast("bigint").alias("first_billing_day"))
    return with_survival(mx)


def web_kind(p: Params) -> Column:
    """pay for base payments not priced like a trial; state events; anything else is other."""
    e = F.col("event_type")
    pay = (e == "subscription_started") & F.coalesce(F.round("amt", 2) != F.lit(p.trial_price), F.lit(True))
    return (F.when(pay, "pay").when(e == "billing_issue", "issue").when(e == "sub_cancelled", "vol")
            .otherwise("other"))


def training_rows(mx: DataFrame) -> DataFrame:
    """Rows old enough for their outcome to have settled; censoring looks at time only."""
    return mx.where("evaluable")


def as_of(mx: DataFrame, t: Column, p: Params) -> DataFrame:
    """The matrix as known at `t`: later payments are gone and the age is counted up to `t`."""
    seen = mx.where(F.col("pay_ts") < t).drop("weeks_obs")
    first = seen.groupBy("sub_id").agg(periods_between(F.min("pay_ts"), t, p.period_days).alias("weeks_obs"))
    return seen.join(first, "sub_id")


def visible_by_step(mx: DataFrame, weeks: int) -> DataFrame:
    """What was known after `weeks` steps of keys at least that old."""
    return (mx.where((F.col("weeks_obs") >= weeks) & (F.col("step_k") <= weeks))
            .withColumn("weeks_obs", F.lit(float(weeks))))


def visible_by_age(mx: DataFrame, weeks: int, p: Params) -> DataFrame:
    """What was known `weeks` periods after each key's first payment."""
    first = mx.groupBy("sub_id").agg(F.min("pay_ts").alias("_f"))
    return (mx.where(F.col("weeks_obs") >= weeks).join(first, "sub_id")
            .where(periods_between("_f", "pay_ts", p.period_days) < weeks).drop("_f")
            .withColumn("weeks_obs", F.lit(float(weeks))))


def censored_share(mx: DataFrame) -> DataFrame:
    """Share of steps that lie beyond what their key's age could show, by step."""
    c = (F.col("step_k") > F.col("weeks_obs")).cast("bigint")
    return mx.groupBy("step_k").agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("n_censored"),
                                    F.avg(c.cast("double")).alias("share"))


def resubscribers(events: DataFrame, p: Params, gap_days: float, key: str = "sub_id") -> DataFrame:
    """Keys with a silence above gap_days, or with more than one trial or conversion."""
    scan = Ordered([key], "ts", ["tie"])
    e = scan.add(events.select(key, "ts", "tie", "event_name"), prev={"_p": F.col("ts")})
    return e.groupBy(key).agg(
        F.max(days_between("_p", "ts")).alias("max_gap"),
        F.count_if(F.col("event_name") == "trial_started").alias("n_trials"),
        F.count_if(F.col("event_name") == "subscription_renewed").alias("n_pays"),
    ).withColumn("long_gap", F.coalesce(F.col("max_gap") > gap_days, F.lit(False)))
