"""Ladders, matrices and survival on the driver's tables."""

from pyspark.sql import functions as F

from tenurekit.functions.exprs import epoch, r6
from tenurekit.operators import ladder as L
from tenurekit.operators import survival as S
from tenurekit.params import ORDERS, USERS
from tenurekit.plans import sql as Q
from tenurekit.plans.registry import query
from tenurekit.plans.stages import staged
from tenurekit.sources.adapters import order_events, sub_events


def users_mx(spark, d):
    return L.mobile_matrix(sub_events(spark, d), USERS)


def orders_mx(spark, d):
    # log and matrix are stored once, as they would be; later steps read the columns they need
    return staged(spark, d, "orders_matrix", lambda: L.mobile_matrix(order_log(spark, d), ORDERS))


def order_log(spark, d):
    return staged(spark, d, "order_log", lambda: order_events(spark, d))


OMX = f"WITH {Q.OE}, {Q.mobile_mx('oe', ORDERS)}"
UMX = f"WITH {Q.SE}, {Q.mobile_mx('se', USERS)}"


@query("payment_ladder", "M1 W2 W3 W4", f"""WITH {Q.SE}, {Q.steps('se', USERS)}
 SELECT sub_id, step_k, epoch_us(ts) AS pay_us, epoch_us(next_ts) AS next_us, round(days_to_next, 6) AS days_to_next FROM st""")
def payment_ladder(spark, d):
    pays = sub_events(spark, d).where("kind = 'pay'").select("sub_id", "ts", "tie")
    out = L.payment_ladder(pays, USERS)
    return out.select("sub_id", "step_k", epoch("ts").alias("pay_us"), epoch("next_ts").alias("next_us"),
                      r6("days_to_next").alias("days_to_next"))


@query("step_flags", "M3 J3", f"""WITH {Q.SE}, {Q.steps('se', USERS)}
 SELECT sub_id, step_k, had_issue, had_vol FROM st""")
def step_flags(spark, d):
    return L.step_flags(sub_events(spark, d), USERS).select("sub_id", "step_k", "had_issue", "had_vol")


@query("step_outcomes", "M4 F1", f"""WITH {Q.SE}, {Q.steps('se', USERS)}
 SELECT outcome, step_k, count(*) AS n FROM (SELECT *, {Q.outcome(USERS)} AS outcome FROM st) GROUP BY ALL""")
def step_outcomes(spark, d):
    st = L.step_flags(sub_events(spark, d), USERS).withColumn("outcome", L.outcome(USERS))
    return st.groupBy("outcome", "step_k").agg(F.count(F.lit(1)).alias("n"))


@query("step_outcomes_no_window", "M4b", f"""WITH {Q.SE}, {Q.steps('se', USERS)}
 SELECT sub_id, step_k, CASE WHEN next_ts IS NOT NULL THEN CASE WHEN had_issue THEN 'recovered' ELSE 'renewed' END
  WHEN had_vol THEN 'voluntary_cancel' WHEN had_issue THEN 'billing_issue' ELSE 'churned' END AS outcome FROM st""")
def step_outcomes_no_window(spark, d):
    return L.step_flags(sub_events(spark, d), USERS).select("sub_id", "step_k", L.outcome(USERS, window=False).alias("outcome"))


CHAIN = f"""WITH {Q.SE}, pay AS (SELECT sub_id, ts, tie, row_number() OVER w AS step_k, lead(ts) OVER w AS next_ts FROM se
  WHERE kind = 'pay' WINDOW w AS (PARTITION BY sub_id ORDER BY ts, tie)),
 fl AS (SELECT p.sub_id, p.step_k, bool_or(true) AS hi FROM pay p JOIN se e ON e.sub_id = p.sub_id AND e.kind = 'issue'
   AND e.ts > p.ts AND e.ts < p.next_ts GROUP BY 1, 2),
 ends AS (SELECT sub_id, max(ts) AS end_ts, arg_max(CASE tie % 3 WHEN 0 THEN 'voluntary' WHEN 1 THEN 'involuntary' ELSE 'unknown' END, (ts, tie)) AS ct
  FROM se WHERE kind = 'vol' GROUP BY 1)
 SELECT p.sub_id, p.step_k, CASE WHEN next_ts IS NOT NULL AND hi THEN 'recovered' WHEN next_ts IS NOT NULL OR end_ts IS NULL OR end_ts <= p.ts
  THEN 'renewed' WHEN ct = 'voluntary' THEN 'voluntary_cancel' WHEN ct = 'involuntary' THEN 'billing_issue' ELSE 'churned' END AS outcome
 FROM pay p LEFT JOIN fl USING (sub_id, step_k) LEFT JOIN ends USING (sub_id)"""


@query("chain_outcomes", "M5", CHAIN)
def chain_outcomes(spark, d):
    e = sub_events(spark, d).withColumn("churn_type", F.when(F.col("tie") % 3 == 0, "voluntary")
                                        .when(F.col("tie") % 3 == 1, "involuntary").otherwise("unknown"))
    e = e.withColumn("kind", F.when(F.col("kind") == "vol", "end").otherwise(F.col("kind")))
    return L.chain_outcome(e, USERS).select("sub_id", "step_k", "outcome")


@query("first_attributes", "M6 A7", f"""WITH {Q.SE} SELECT sub_id, arg_min(app_id, (ts, tie)) FILTER (app_id IS NOT NULL) AS app_id,
  arg_min(geo, (ts, tie)) FILTER (geo IS NOT NULL) AS geo, arg_min(media_source, (ts, tie)) FILTER (media_source IS NOT NULL) AS media_source,
  strftime(min(ts), '%Y-%m') AS cohort_month FROM se GROUP BY 1""")
def first_attributes(spark, d):
    e = sub_events(spark, d)
    month = e.groupBy("sub_id").agg(F.date_format(F.min("ts"), "yyyy-MM").alias("cohort_month"))
    return L.first_values(e, "sub_id", ["app_id", "geo", "media_source"]).join(month, "sub_id")


@query("observation_age", "M7", f"""WITH {Q.SE}, m AS (SELECT max(ts) AS t FROM se)
 SELECT sub_id, round({Q.days('min(ts)', "any_value(t)")} / 1.0, 6) AS from_any, round({Q.days("min(ts) FILTER (kind = 'pay')", "any_value(t)")} / 1.0, 6) AS from_pay,
  round({Q.days("min(ts) FILTER (kind = 'pay')", "TIMESTAMP '2024-02-01'")}, 6) AS fixed FROM se, m GROUP BY 1""")
def observation_age(spark, d):
    e = sub_events(spark, d)
    pays, now = e.where("kind = 'pay'"), F.lit("2024-02-01").cast("timestamp")
    a = L.observation_age(e, USERS).select("sub_id", r6("weeks_obs").alias("from_any"))
    b = L.observation_age(pays, USERS, now=L.snapshot(e)).select("sub_id", r6("weeks_obs").alias("from_pay"))
    c = L.observation_age(pays, USERS, now=now).select("sub_id", r6("weeks_obs").alias("fixed"))
    return a.join(b, "sub_id", "left").join(c, "sub_id", "left")


@query("plan_interval", "M8", f"""WITH {Q.SE}, {Q.steps('se', USERS)}, {Q.interval()}
 SELECT sub_id, plan_interval, round(median_gap, 6) AS median_gap FROM pi""")
def plan_interval(spark, d):
    st = L.payment_ladder(sub_events(spark, d).where("kind = 'pay'").select("sub_id", "ts", "tie"), USERS)
    return L.plan_interval(st).withColumn("median_gap", r6("median_gap"))


@query("trial_days", "M9", f"""WITH {Q.SE} SELECT sub_id, {Q.whole("min(ts) FILTER (event_name = 'trial_started')", "min(ts) FILTER (event_name = 'subscription_renewed')")} AS trial_days
 FROM se GROUP BY 1""")
def trial_days(spark, d):
    return L.trial_days(sub_events(spark, d), "trial_started", "subscription_renewed")


MX_OUT = """SELECT sub_id, step_k, state_from, outcome, round(weeks_obs, 6) AS weeks_obs, epoch_us(pay_ts) AS pay_us,
 round(days_to_next, 6) AS days_to_next, app_id, geo, media_source, attribution_source, plan_interval, trial_days, cohort_month,
 billing_day_of_month, survived::BIGINT AS survived, died::BIGINT AS died FROM mx"""


def mx_out(mx):
    return mx.select("sub_id", "step_k", "state_from", "outcome", r6("weeks_obs").alias("weeks_obs"),
                     epoch("pay_ts").alias("pay_us"), r6("days_to_next").alias("days_to_next"), "app_id", "geo",
                     "media_source", "attribution_source", "plan_interval", "trial_days", "cohort_month",
                     "billing_day_of_month", "survived", "died")


@query("step_matrix", "M10 M7 J1", f"{OMX} {MX_OUT}")
def step_matrix(spark, d):
    return mx_out(orders_mx(spark, d))


@query("user_step_matrix", "M10", f"{UMX} {MX_OUT}")
def user_step_matrix(spark, d):
    return mx_out(users_mx(spark, d))


@query("censored_share", "M12", f"{OMX} SELECT step_k, count(*) AS n, sum(CASE WHEN step_k > weeks_obs THEN 1 ELSE 0 END)::BIGINT AS n_censored, "
       "round(avg(CASE WHEN step_k > weeks_obs THEN 1 ELSE 0 END), 6) AS share FROM mx GROUP BY 1")
def censored_share(spark, d):
    return L.censored_share(orders_mx(spark, d)).withColumn("share", r6("share"))


@query("matrix_as_of", "M13", f"""{OMX}, a AS (SELECT * FROM mx WHERE pay_ts < TIMESTAMP '1998-07-01')
 SELECT sub_id, step_k, outcome, round({Q.days("min(pay_ts) OVER (PARTITION BY sub_id)", "TIMESTAMP '1998-07-01'")} / {ORDERS.period_days}, 6) AS weeks_obs FROM a""")
def matrix_as_of(spark, d):
    t = F.lit("1998-07-01").cast("timestamp")
    return L.as_of(orders_mx(spark, d), t, ORDERS).select("sub_id", "step_k", "outcome", r6("weeks_obs").alias("weeks_obs"))


@query("visible_by_step", "M14", f"{OMX} SELECT sub_id, step_k, outcome, 6.0::DOUBLE AS weeks_obs FROM mx WHERE weeks_obs >= 6 AND step_k <= 6")
def visible_by_step(spark, d):
    return L.visible_by_step(orders_mx(spark, d), 6).select("sub_id", "step_k", "outcome", "weeks_obs")


@query("visible_by_age", "M14 W7", f"""{OMX} SELECT sub_id, step_k, outcome, 6.0::DOUBLE AS weeks_obs FROM
 (SELECT *, min(pay_ts) OVER (PARTITION BY sub_id) AS f FROM mx) WHERE weeks_obs >= 6 AND {Q.days('f', 'pay_ts')} / {ORDERS.period_days} < 6""")
def visible_by_age(spark, d):
    return L.visible_by_age(orders_mx(spark, d), 6, ORDERS).select("sub_id", "step_k", "outcome", "weeks_obs")


@query("resubscribers", "M15", f"""WITH {Q.SE}, g AS (SELECT *, lag(ts) OVER (PARTITION BY sub_id ORDER BY ts, tie) AS pv FROM se)
 SELECT sub_id, round(max({Q.days('pv', 'ts')}), 6) AS max_gap, count(*) FILTER (event_name = 'trial_started') AS n_trials,
  count(*) FILTER (event_name = 'subscription_renewed') AS n_pays, coalesce(max({Q.days('pv', 'ts')}) > 2, false) AS long_gap FROM g GROUP BY 1""")
def resubscribers(spark, d):
    return L.resubscribers(sub_events(spark, d), USERS, 2.0).withColumn("max_gap", r6("max_gap"))


@query("direct_survival", "P6 J9", f"{OMX}, {Q.survival('mx', ORDERS)} SELECT app_id, k, mature, alive, round(fact, 6) AS fact FROM ds")
def direct_survival(spark, d):
    return S.direct_survival(orders_mx(spark, d), ORDERS).withColumn("fact", r6("fact"))


@query("offset_survival", "P7", f"{OMX}, {Q.survival('mx', ORDERS, offset=ORDERS.return_periods)} SELECT app_id, k, mature, alive, round(fact, 6) AS fact FROM ds")
def offset_survival(spark, d):
    return S.direct_survival(orders_mx(spark, d), ORDERS, offset=ORDERS.return_periods).withColumn("fact", r6("fact"))


@query("stepwise_retention", "P8", f"{OMX}, {Q.crash('mx', ORDERS)} SELECT app_id, k, at_risk, round(r, 6) AS retention FROM cr_k")
def stepwise_retention(spark, d):
    return S.stepwise_retention(orders_mx(spark, d), ORDERS).select("app_id", "k", "at_risk", r6("retention").alias("retention"))


@query("select_apps", "P9 A2 P8", f"{OMX}, {Q.crash('mx', ORDERS)} SELECT app_id, payers, round(worst, 6) AS worst, crash FROM cr")
def select_apps(spark, d):
    return S.select_apps(orders_mx(spark, d), ORDERS).withColumn("worst", r6("worst"))


@query("app_facts", "P9 P6", f"{OMX}, {Q.survival('mx', ORDERS)}, {Q.crash('mx', ORDERS)} SELECT app_id, k, mature, alive, round(fact, 6) AS fact, crash FROM ds JOIN cr USING (app_id)")
def app_facts(spark, d):
    return S.app_facts(orders_mx(spark, d), ORDERS).withColumn("fact", r6("fact"))


@query("fact_prefix", "P22", f"""{OMX}, {Q.survival('mx', ORDERS, by='geo')} SELECT geo, k, mature, round(fact, 6) AS fact FROM
 (SELECT *, min(CASE WHEN mature >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY geo ORDER BY k) AS ok FROM ds) WHERE ok = 1""")
def fact_prefix(spark, d):
    f = S.direct_survival(orders_mx(spark, d), ORDERS, by=("geo",))
    return S.fact_prefix(f, 50, ("geo",)).select("geo", "k", "mature", r6("fact").alias("fact"))


@query("cohort_dynamics", "P19", f"{OMX}, {Q.survival('mx', ORDERS, by='app_id, cohort_month')} SELECT app_id, cohort_month, k, mature, round(fact, 6) AS fact FROM ds WHERE k IN (2, 4, 8)")
def cohort_dynamics(spark, d):
    f = S.direct_survival(orders_mx(spark, d), ORDERS, by=("app_id", "cohort_month"))
    return f.where(F.col("k").isin(2, 4, 8)).select("app_id", "cohort_month", "k", "mature", r6("fact").alias("fact"))


@query("life_table", "P15", f"""WITH {Q.SE}, t AS (SELECT sub_id, min(ts) FILTER (kind = 'pay') AS s, min(ts) FILTER (kind = 'vol') AS x, (SELECT max(ts) FROM se) AS now
  FROM se GROUP BY 1), g AS (SELECT unnest([0, 1, 2, 4, 8, 12, 26])::BIGINT AS week)
 SELECT week, count(*) AS n, count(*) FILTER (x IS NULL OR greatest({Q.days('s', 'x')}, 0) >= week) AS alive,
  round(avg(CASE WHEN x IS NULL OR greatest({Q.days('s', 'x')}, 0) >= week THEN 1 ELSE 0 END), 6) AS survival
 FROM t JOIN g ON {Q.days('s', 'now')} >= week GROUP BY 1""")
def life_table(spark, d):
    e = sub_events(spark, d)
    t = e.groupBy("sub_id").agg(F.min(F.when(F.col("kind") == "pay", F.col("ts"))).alias("start"),
                                F.min(F.when(F.col("kind") == "vol", F.col("ts"))).alias("death"))
    t = t.withColumn("now", L.snapshot(e))
    return S.life_table(t, (0, 1, 2, 4, 8, 12, 26), 1.0).withColumn("survival", r6("survival"))
