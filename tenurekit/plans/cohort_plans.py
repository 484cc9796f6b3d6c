"""Cohort facts, calibration and extrapolation on the driver's tables."""

from pyspark.sql import functions as F

from tenurekit.functions.exprs import r6
from tenurekit.functions.ordered import cut
from tenurekit.operators import calibrate as C
from tenurekit.operators import cohorts as K
from tenurekit.operators import hazard as H
from tenurekit.operators import ladder as L
from tenurekit.operators import quality as Z
from tenurekit.params import ORDERS
from tenurekit.params import ORDERS_WEB as P
from tenurekit.plans import sql as Q
from tenurekit.plans.ladder_plans import OMX, order_log, orders_mx
from tenurekit.plans.registry import query
from tenurekit.plans.stages import staged
from tenurekit.sources.adapters import web_events

PRICE, TOL, FULL = 25.0, 20.0, 5.0
BASE = ("subscription_started",)


def golden(spark, d):
    e = staged(spark, d, "web_log", lambda: web_events(spark, d))
    return e.select(F.lower("email").alias("sub_id"), F.col("event_type").alias("event_name"), "ts",
                    F.col("amt").alias("amount"), "tie", F.col("subscription_key").alias("price_id"), "payment_provider")


def members(spark, d, e=None):
    s = K.subscription_starts(golden(spark, d) if e is None else e, "trial_started")
    return s.withColumn("cohort", F.to_date(F.date_trunc("quarter", "start_ts")))


def facts(spark, d):
    def build():
        e = golden(spark, d)
        return K.cohort_facts(K.numbered_payments(e, BASE, PRICE, TOL, P), members(spark, d, e), L.snapshot(e), P)

    return staged(spark, d, "cohort_facts", build)


GO = f"""WITH {Q.WE}, go AS (SELECT lower(email) AS sub_id, event_type AS event_name, ts, amt AS amount, tie, subscription_key AS price_id, payment_provider FROM we),
 ss AS (SELECT sub_id, coalesce(min(ts) FILTER (event_name = 'trial_started'), min(ts)) AS start_ts,
   CASE WHEN count(*) FILTER (event_name = 'trial_started') > 0 THEN 'trial_started' ELSE 'first_local_event' END AS start_source FROM go GROUP BY 1),
 np0 AS (SELECT sub_id, ts, event_name, amount, min(tie) AS tie FROM go WHERE event_name = 'subscription_started' AND abs(amount - 25) <= 20 GROUP BY 1, 2, 3, 4),
 np AS (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY ts, tie) - 1 AS rebill_number FROM np0),
 pr AS (SELECT np.*, CAST(date_trunc('quarter', start_ts) AS DATE) AS cohort FROM np JOIN ss USING (sub_id)),
 cr1 AS (SELECT cohort, rebill_number, count(*) AS au, sum(amount) AS rev FROM pr GROUP BY 1, 2),
 cz AS (SELECT cohort, max(au) FILTER (rebill_number = 0) AS payers, max(rebill_number) AS present, greatest(0, CAST(floor({Q.whole('cohort::TIMESTAMP', '(SELECT max(ts) FROM go)')} / {P.period_days}) AS BIGINT) - 2) AS max_mature FROM cr1 GROUP BY 1),
 cf AS (SELECT cohort, k AS rebill_number, payers, max_mature, coalesce(au, 0) AS active_users, coalesce(rev, 0) AS revenue, sum(coalesce(rev, 0)) OVER (PARTITION BY cohort ORDER BY k) AS cumr
  FROM cz JOIN (SELECT unnest(range(0, 60))::BIGINT AS k) g ON k <= least(present, max_mature) LEFT JOIN cr1 USING (cohort) WHERE cr1.rebill_number = k OR cr1.rebill_number IS NULL)"""


@query("subscription_starts", "E22", f"{GO} SELECT sub_id, epoch_us(start_ts) AS start_us, start_source FROM ss")
def subscription_starts(spark, d):
    return K.subscription_starts(golden(spark, d), "trial_started").select("sub_id", F.unix_micros("start_ts").alias("start_us"), "start_source")


@query("price_cohort", "E23 A5 F3", f"""{GO}, am AS (SELECT sub_id, round(amount, 2) AS a, count(*) AS n FROM go WHERE amount > 0 GROUP BY 1, 2),
 md AS (SELECT sub_id, arg_min(a, (-n, a)) FILTER (a >= 5) AS m FROM am GROUP BY 1)
 SELECT ss.sub_id, m AS inferred_price, coalesce(abs(m - 25) <= 20, false) AS in_price_cohort, CASE WHEN m IS NOT NULL THEN 'mode_of_full_amounts' WHEN md.sub_id IS NOT NULL THEN 'low_amount_only_unknown_plan' ELSE 'no_local_price' END AS reason
 FROM ss LEFT JOIN md USING (sub_id)""")
def price_cohort(spark, d):
    e = golden(spark, d)
    return K.price_cohort(e, K.subscription_starts(e, "trial_started"), PRICE, TOL, FULL)


@query("price_cohort_exact", "E23 E25 F8", f"""{GO} SELECT sub_id, NULL::DOUBLE AS inferred_price, sub_id IN (SELECT sub_id FROM go WHERE price_id = 'P') AS in_price_cohort, 'exact:price_id' AS reason FROM ss""")
def price_cohort_exact(spark, d):
    e = golden(spark, d)
    return K.price_cohort(e, K.subscription_starts(e, "trial_started"), PRICE, TOL, FULL, price_id="price_id", target_id="P")


@query("numbered_payments", "M2 F3 U2", f"{GO} SELECT sub_id, epoch_us(ts) AS pay_us, amount, rebill_number FROM np")
def numbered_payments(spark, d):
    n = K.numbered_payments(golden(spark, d), BASE, PRICE, TOL, P)
    return n.select("sub_id", F.unix_micros("ts").alias("pay_us"), "amount", "rebill_number")


CF_OUT = """SELECT cohort, rebill_number, payers, max_mature, active_users, round(revenue, 2) AS revenue, round(active_users / payers, 6) AS rebill_percent,
 round(revenue / nullif(active_users, 0), 8) AS arpu_at_payment, round(cumr, 2) AS cumulative_revenue, round(cumr / payers, 8) AS payer_ltv FROM cf"""


def facts_out(f):
    return f.select("cohort", "rebill_number", "payers", "max_mature", "active_users", F.round("revenue", 2).alias("revenue"), r6("rebill_percent").alias("rebill_percent"),
                    F.round("arpu_at_payment", 8).alias("arpu_at_payment"), F.round("cumulative_revenue", 2).alias("cumulative_revenue"), F.round("payer_ltv", 8).alias("payer_ltv"))


@query("cohort_facts", "P10", f"{GO} {CF_OUT}")
def cohort_facts(spark, d):
    return facts_out(facts(spark, d))


@query("admitted_cohorts", "P11 A9", f"{GO} {CF_OUT} WHERE payers >= 15 AND max_mature >= 3")
def admitted_cohorts(spark, d):
    return facts_out(K.admitted(facts(spark, d)))


@query("cohort_coverage", "P12 J8 U3", f"""{GO}, {Q.OE}, {Q.mobile_mx('oe', ORDERS)}, mxk AS (SELECT DISTINCT 'u' || sub_id || '@mail' AS sub_id FROM mx),
 am AS (SELECT sub_id, round(amount, 2) AS a, count(*) AS n FROM go WHERE amount > 0 GROUP BY 1, 2), md AS (SELECT sub_id, arg_min(a, (-n, a)) FILTER (a >= 5) AS m FROM am GROUP BY 1),
 fg AS (SELECT ss.sub_id, coalesce(abs(m - 25) <= 20, false) AS pc, ss.sub_id IN (SELECT sub_id FROM np WHERE rebill_number = 0) AS fp, ss.sub_id IN (SELECT sub_id FROM mxk) AS im FROM ss LEFT JOIN md USING (sub_id))
 SELECT count(*) AS starts, count(*) FILTER (pc) AS on_plan, count(*) FILTER (pc AND fp) AS first_payers, count(*) FILTER (pc AND fp AND im) AS in_matrix, count(*) FILTER (pc AND fp AND NOT im) AS missing,
  round(count(*) FILTER (pc AND fp) / count(*) FILTER (pc), 6) AS first_pay_rate, round(count(*) FILTER (pc AND fp AND im) / count(*) FILTER (pc AND fp), 6) AS matrix_coverage FROM fg""")
def cohort_coverage(spark, d):
    e = golden(spark, d)
    starts = K.subscription_starts(e, "trial_started")
    plan = K.price_cohort(e, starts, PRICE, TOL, FULL)
    keys = orders_mx(spark, d).select("sub_id").distinct().select(F.concat(F.lit("u"), F.col("sub_id").cast("string"), F.lit("@mail")).alias("sub_id"))
    s = K.coverage_summary(K.coverage(starts, plan, K.numbered_payments(e, BASE, PRICE, TOL, P), keys))
    return s.withColumns({"first_pay_rate": r6("first_pay_rate"), "matrix_coverage": r6("matrix_coverage")})


ARPU = f"""{OMX}, pay1 AS (SELECT sub_id, ts, avg(amount / 1000) AS a FROM oe WHERE kind = 'pay' GROUP BY 1, 2),
 ar0 AS (SELECT step_k, avg(a) AS arpu, count(a) AS n FROM mx JOIN pay1 ON pay1.sub_id = mx.sub_id AND pay1.ts = pay_ts GROUP BY 1),
 arp AS (SELECT k AS step_k, last_value(arpu IGNORE NULLS) OVER (ORDER BY k) AS arpu, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, {ORDERS.hmax + 1}))::BIGINT AS k) g LEFT JOIN ar0 ON step_k = k)"""


def order_payments(spark, d):
    return order_log(spark, d).where("kind = 'pay'").select("sub_id", "ts", "tie", (F.col("amount") / 1000).alias("amount"), "media_source", "app_id")


@query("arpu_by_step", "P20 J7 W8", f"{ARPU} SELECT step_k, round(arpu, 6) AS arpu, n FROM arp")
def arpu_by_step(spark, d):
    return K.arpu_by_step(orders_mx(spark, d), order_payments(spark, d), ORDERS.hmax).withColumn("arpu", r6("arpu"))


@query("payment_funnel", "P13", f"""{ARPU}, pp AS (SELECT sub_id, max(step_k) AS ms, max(weeks_obs) AS wo FROM mx GROUP BY 1),
 f AS (SELECT k, count(*) FILTER (wo >= k) AS n_mature, count(*) FILTER (wo >= k AND ms >= k) AS paid_at_step, count(*) FILTER (ms >= k) AS paid_at_least, count(*) FILTER (ms = k) AS paid_exactly,
   count(*) FILTER (wo >= k AND ms >= k + 1) / count(*) FILTER (wo >= k) AS survival FROM pp JOIN (SELECT unnest(range(1, {ORDERS.hmax + 1}))::BIGINT AS k) g ON true GROUP BY 1)
 SELECT k, n_mature, paid_at_step, paid_at_least, paid_exactly, round(survival, 6) AS survival, round(arpu, 6) AS arpu, round(paid_at_step / n_mature, 6) AS paid_share, round(survival * arpu, 6) AS increment,
  round(sum(survival * arpu) OVER (ORDER BY k), 6) AS cumulative FROM f JOIN arp ON step_k = k""")
def payment_funnel(spark, d):
    mx = orders_mx(spark, d)
    f = K.payment_funnel(mx, K.arpu_by_step(mx, order_payments(spark, d), ORDERS.hmax), ORDERS)
    return f.withColumns({c: r6(c) for c in ("survival", "arpu", "paid_share", "increment", "cumulative")})


@query("payment_distribution", "P14", f"""{OMX}, pp AS (SELECT sub_id, max(step_k) AS ms, max(weeks_obs) AS wo FROM mx GROUP BY 1)
 SELECT k AS week, least(ms, k) AS payments, count(*) AS n FROM pp JOIN (SELECT unnest(range(1, 11))::BIGINT AS k) g ON wo >= k GROUP BY 1, 2""")
def payment_distribution(spark, d):
    return K.payment_distribution(orders_mx(spark, d), 10)


def curve_parts(spark, d):
    pay = order_payments(spark, d)
    subs = pay.groupBy("sub_id").agg(F.min("ts").alias("start_ts"), F.min_by("app_id", F.struct("ts", "tie")).alias("app_id"))
    return subs, pay, L.snapshot(pay)


def averaged(by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""{Q.OE}, pa AS (SELECT sub_id, ts, tie, amount / 1000 AS amount, app_id FROM oe WHERE kind = 'pay'),
 sb AS (SELECT sub_id, min(ts) AS st, arg_min(app_id, (ts, tie)) AS app_id FROM pa GROUP BY 1),
 sa AS (SELECT *, {Q.days('st', '(SELECT max(ts) FROM pa)')} / {ORDERS.period_days} AS age FROM sb),
 ac AS (SELECT {b}week, count(*) AS n, avg(m) AS cum_avg FROM (SELECT {'sa.' + by + ', ' if by else ''}sa.sub_id, week, coalesce(sum(amount), 0) AS m FROM sa JOIN (SELECT unnest(range(0, 25))::BIGINT AS week) g ON age >= week + 1
   LEFT JOIN pa ON pa.sub_id = sa.sub_id AND greatest(floor({Q.days('st', 'ts')} / {ORDERS.period_days}), 0) <= week GROUP BY ALL) GROUP BY ALL)"""


@query("averaged_curve", "P17 T19", f"WITH {averaged()} SELECT week, n, round(cum_avg, 4) AS cum_avg FROM ac")
def averaged_curve(spark, d):
    return K.averaged_curve(*curve_parts(spark, d), ORDERS, 24).withColumn("cum_avg", F.round("cum_avg", 4))


@query("averaged_curve_by_app", "P17", f"WITH {averaged('app_id')} SELECT app_id, week, n, round(cum_avg, 4) AS cum_avg FROM ac")
def averaged_curve_by_app(spark, d):
    return K.averaged_curve(*curve_parts(spark, d), ORDERS, 24, ["app_id"]).withColumn("cum_avg", F.round("cum_avg", 4))


@query("pooled_curve", "A17", f"{GO} SELECT rebill_number, round(sum(cumr) / sum(payers), 6) AS payer_ltv, count(*) AS cohorts FROM cf GROUP BY 1")
def pooled_curve(spark, d):
    return K.pooled_curve(facts(spark, d)).withColumn("payer_ltv", r6("payer_ltv"))


FACT_TOTALS = f"""{GO}, fv AS (SELECT cohort, max(payers) AS payers, sum(active_users) AS payments, arg_max(cumr, rebill_number) AS revenue, max(cumr / payers) FILTER (rebill_number = 3) AS anchor FROM cf GROUP BY 1),
 fk AS (SELECT cohort, sub_id, count(*) AS n, sum(amount) AS m, max(rebill_number) AS last, sum(amount) FILTER (rebill_number <= 3) AS t FROM pr JOIN cz USING (cohort) WHERE rebill_number <= max_mature GROUP BY 1, 2),
 fe AS (SELECT cohort, count(*) AS payers, sum(n) AS payments, sum(m) AS revenue, CASE WHEN max(last) >= 3 THEN sum(t) / count(*) END AS anchor FROM fk GROUP BY 1),
 fa AS (SELECT * FROM (SELECT cohort, payers::DOUBLE AS payers, payments::DOUBLE AS payments, revenue::DOUBLE AS revenue, anchor::DOUBLE AS anchor FROM fv) UNPIVOT (value FOR metric IN (payers, payments, revenue, anchor))),
 fb AS (SELECT * FROM (SELECT cohort, payers::DOUBLE AS payers, payments::DOUBLE AS payments, revenue::DOUBLE AS revenue, anchor::DOUBLE AS anchor FROM fe) UNPIVOT (expected FOR metric IN (payers, payments, revenue, anchor)))
 SELECT cohort, metric, round(value, 4) AS value, round(expected, 4) AS expected, coalesce(abs(value - expected) <= 1e-9 * greatest(1, abs(expected)), false) AS ok FROM fa FULL JOIN fb USING (cohort, metric)"""


@query("facts_reconciliation", "Q5 P10", FACT_TOTALS)
def facts_reconciliation(spark, d):
    """The cohort facts against the payments themselves, at any scale."""
    e = golden(spark, d)
    plain = K.payment_totals(K.numbered_payments(e, BASE, PRICE, TOL, P), members(spark, d, e), L.snapshot(e), P)
    out = Z.reconcile_tables(K.fact_totals(facts(spark, d)), plain, ["cohort"])
    return out.withColumns({"value": F.round("value", 4), "expected": F.round("expected", 4)})


# ------------------------------------------------------------------ calibration
POOL = f"""{GO}, ad AS (SELECT * FROM cf WHERE payers >= 15 AND max_mature >= 3),
 ph0 AS (SELECT cohort, rebill_number AS k, active_users AS cur, lag(active_users) OVER (PARTITION BY cohort ORDER BY rebill_number) AS prv FROM ad),
 ph AS (SELECT k, sum(prv)::BIGINT AS n_at_risk, sum(prv - cur)::BIGINT AS died, sum(prv - cur) / sum(prv) AS h FROM ph0 WHERE k >= 1 GROUP BY 1)"""
FITSQL = f"""{POOL}, {Q.OE}, {{mob}}, {Q.hbase('o_mx', ORDERS, 'ref')},
 rl AS (SELECT k, n_at_risk AS w, (k - 1)::DOUBLE AS x, ln(nullif(ph.h, 0) / ref.h) AS y FROM ph JOIN ref ON step_k = k WHERE n_at_risk >= 40),
 ft0 AS (SELECT sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, (SELECT max(k) FROM rl) AS k_max FROM rl WHERE y IS NOT NULL),
 ft AS (SELECT (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS beta, (sy - beta * sx) / sw AS alpha, k_max FROM ft0),
 co AS (SELECT k AS step_k, CASE WHEN k <= k_max THEN exp(alpha + beta * (k - 1)) WHEN k <= k_max + 3 THEN exp(alpha + beta * (k_max - 1)) * (1 - (k - k_max) / 4.0::DOUBLE) + (k - k_max) / 4.0::DOUBLE ELSE 1 END AS c
  FROM ft JOIN (SELECT unnest(range(1, {ORDERS.hmax + 1}))::BIGINT AS k) g ON true),
 ch AS (SELECT step_k, ref.h * c AS h FROM co JOIN ref USING (step_k)),
 cs AS (SELECT step_k AS k, product(1 - least(greatest(h, 0.001), 0.999)) OVER (ORDER BY step_k) AS s FROM ch),
 gs0 AS (SELECT k, CASE WHEN k = 0 THEN 9.99 WHEN k <= {ORDERS.hmax} THEN coalesce(s * 9.99, 0) ELSE (SELECT sum(s * 9.99) / 8 FROM cs WHERE k > {ORDERS.hmax - 8}) END AS inc FROM (SELECT unnest(range(0, {ORDERS.h_ext + 1}))::BIGINT AS k) g LEFT JOIN cs USING (k)),
 gs AS (SELECT k, inc, sum(inc) OVER (ORDER BY k) AS value, sum(CASE WHEN k = 0 THEN 1 WHEN k % 4 = 0 THEN inc / 9.99 ELSE 0 END) OVER (ORDER BY k) AS ups_value FROM gs0)"""
_mob = Q.mobile_mx("oe", ORDERS)
for a in ("pay", "kept", "fl", "st", "pi", "lev", "mx"):
    _mob = _mob.replace(f" {a} AS (", f" o_{a} AS (").replace(f"FROM {a} ", f"FROM o_{a} {a} ").replace(f"JOIN {a} ", f"JOIN o_{a} {a} ")
_mob = _mob.replace("FROM o_kept kept k", "FROM o_kept k").replace("FROM o_pay pay WHERE", "FROM o_pay WHERE")
FITSQL = FITSQL.replace("{mob}", _mob)


def ref_hazard(spark, d):
    return staged(spark, d, "orders_hazard", lambda: H.portfolio_hazard(orders_mx(spark, d), ORDERS))


def pooled(spark, d):
    return C.pooled_hazard(K.admitted(facts(spark, d)))


def fitted(spark, d):
    ref = ref_hazard(spark, d)
    corr = C.correction(C.log_linear_fit(pooled(spark, d), ref), ORDERS.hmax)
    return ref, corr


def shape(spark, d):
    def build():
        ref, corr = fitted(spark, d)
        s = C.survival_of(C.corrected_hazard(ref, corr))
        return C.cycle_curve(C.growth_shape(s, 9.99, ORDERS.hmax, ORDERS.h_ext), 9.99, 4)

    return staged(spark, d, "growth_shape", build)


@query("pooled_hazard", "C1 W2", f"{POOL} SELECT k, n_at_risk, died, round(h, 6) AS h FROM ph")
def pooled_hazard(spark, d):
    return pooled(spark, d).withColumn("h", r6("h"))


@query("log_linear_fit", "C2 A13", f"{FITSQL} SELECT round(alpha, 6) AS alpha, round(beta, 6) AS beta, k_max FROM ft")
def log_linear_fit(spark, d):
    return C.log_linear_fit(pooled(spark, d), ref_hazard(spark, d)).select(r6("alpha").alias("alpha"), r6("beta").alias("beta"), "k_max")


@query("hazard_correction", "C3", f"{FITSQL} SELECT step_k, round(c, 6) AS c, round(h, 6) AS h FROM co JOIN ch USING (step_k)")
def hazard_correction(spark, d):
    ref, corr = fitted(spark, d)
    return corr.join(C.corrected_hazard(ref, corr), "step_k").select("step_k", r6("c").alias("c"), r6("h").alias("h"))


@query("pointwise_hazard", "C4", f"""{POOL}, fv AS (SELECT coalesce(arg_max(h, k) FILTER (n_at_risk >= 40), arg_max(h, k)) AS flat FROM ph)
 SELECT g.k AS step_k, round(CASE WHEN coalesce(n_at_risk >= 40, false) THEN h ELSE flat END, 6) AS h FROM (SELECT unnest(range(1, 13))::BIGINT AS k) g JOIN fv ON true LEFT JOIN ph USING (k)""")
def pointwise_hazard(spark, d):
    return C.pointwise_hazard(pooled(spark, d), 12).withColumn("h", r6("h"))


@query("growth_shape", "C5 C7 W5", f"{FITSQL} SELECT k, round(value, 6) AS value, round(ups_value, 6) AS ups_value FROM gs")
def growth_shape(spark, d):
    return shape(spark, d).select("k", r6("value").alias("value"), r6("ups_value").alias("ups_value"))


@query("shape_ratio", "C6", f"""{FITSQL}, pa AS (SELECT DISTINCT max_mature AS target, payers % 5 + 1 AS anchor FROM cf WHERE payers IS NOT NULL)
 SELECT target, anchor, round(t.value / a.value, 6) AS ratio FROM pa JOIN gs t ON t.k = least(target, {ORDERS.h_ext}) JOIN gs a ON a.k = least(anchor, {ORDERS.h_ext})""")
def shape_ratio(spark, d):
    f = facts(spark, d).where("payers is not null")
    pairs = f.select(F.col("max_mature").alias("target"), (F.col("payers") % 5 + 1).alias("anchor")).distinct()
    return C.shape_ratio(shape(spark, d), pairs, ORDERS.h_ext).withColumn("ratio", r6("ratio"))


@query("anchored_curve", "C8", f"""{FITSQL}, an AS (SELECT cohort, 3::BIGINT AS anchor, cumr / payers AS fact FROM cf WHERE rebill_number = 3)
 SELECT cohort, k, round(value * fact / (SELECT value FROM gs WHERE k = 3), 6) AS anchored FROM an JOIN gs ON true""")
def anchored_curve(spark, d):
    a = facts(spark, d).where("rebill_number = 3").select("cohort", F.lit(3).cast("bigint").alias("anchor"), F.col("payer_ltv").alias("fact"))
    g = a.select("cohort").withColumn("_s", shape(spark, d).agg(F.collect_list(F.struct("k", "value"))).scalar())
    m = g.select("cohort", F.explode("_s").alias("r")).select("cohort", "r.*")
    return C.anchored(m, a, ["cohort"]).select("cohort", "k", r6("anchored").alias("anchored"))


@query("spread_band", "C13", f"{FITSQL} SELECT k, round(value * (1 - 0.0843), 6) AS lower, round(value * (1 + 0.0843), 6) AS upper FROM gs")
def spread_band(spark, d):
    return C.spread_band(shape(spark, d), "value", 0.0843).select("k", r6("lower").alias("lower"), r6("upper").alias("upper"))


def smooth_sql(curve: str, by: str = "", n: int = 4, where: str = "", name: str = "sm") -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""{name}_i AS (SELECT {b}week, cum_avg - lag(cum_avg) OVER ({part}ORDER BY week) AS inc FROM {curve} {where}),
 {name} AS (SELECT *, CASE WHEN count(inc) OVER w >= {max(2, n // 2)} THEN avg(inc) OVER w END AS smoothed FROM {name}_i WINDOW w AS ({part}ORDER BY week ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"""


def decay_sql(sm: str, lo: int, hi: int, by: str = "", name: str = "df") -> str:
    b = f"{by}, " if by else ""
    inw = f"FILTER (week BETWEEN {lo} AND {hi})"
    return f"""{name}0 AS (SELECT {b}regr_slope(ln(smoothed), week) {inw} AS sw, regr_intercept(ln(smoothed), week) {inw} AS iw, count(*) {inw} AS nw, regr_slope(ln(smoothed), week) AS sa,
   regr_intercept(ln(smoothed), week) AS ia, count(*) AS na FROM {sm} WHERE smoothed > 0 {'GROUP BY ' + by if by else ''}),
 {name} AS (SELECT {b}exp(CASE WHEN nw < 4 OR sw >= 0 THEN ia ELSE iw END) AS a, exp(CASE WHEN nw < 4 OR sw >= 0 THEN sa ELSE sw END) AS r, nw AS points, nw < 4 OR sw >= 0 AS widened FROM {name}0 WHERE na >= 3)"""


@query("smoothed_increments", "W9 W10", f"WITH {averaged()}, {smooth_sql('ac')} SELECT week, round(inc, 6) AS inc, round(smoothed, 6) AS smoothed FROM sm")
def smoothed_increments(spark, d):
    s = C.smoothed_increments(K.averaged_curve(*curve_parts(spark, d), ORDERS, 24))
    return s.select("week", r6("inc").alias("inc"), r6("smoothed").alias("smoothed"))


@query("decay_fit", "C9", f"WITH {averaged('app_id')}, {smooth_sql('ac', 'app_id')}, {decay_sql('sm', 8, 16, 'app_id')} SELECT app_id, round(a, 5) AS a, round(r, 6) AS r, points, widened FROM df")
def decay_fit(spark, d):
    c = K.averaged_curve(*curve_parts(spark, d), ORDERS, 24, ["app_id"])
    f = C.decay_fit(C.smoothed_increments(c, by=["app_id"]), 8, 16, ["app_id"])
    return f.withColumns({"a": F.round("a", 5), "r": r6("r")})


@query("extrapolated_curve", "C10", f"""WITH {averaged('app_id')}, {smooth_sql('ac', 'app_id')}, {decay_sql('sm', 8, 16, 'app_id')}
 SELECT app_id, g.week, round(cum_avg + sum(a * pow(r, g.week)) OVER (PARTITION BY app_id ORDER BY g.week), 4) AS cum FROM df JOIN ac USING (app_id) JOIN (SELECT unnest(range(17, 41))::BIGINT AS week) g ON true WHERE ac.week = 16""")
def extrapolated_curve(spark, d):
    c = cut(K.averaged_curve(*curve_parts(spark, d), ORDERS, 24, ["app_id"]))
    f = C.decay_fit(C.smoothed_increments(c, by=["app_id"]), 8, 16, ["app_id"])
    a = f.join(c.where("week = 16").select("app_id", F.col("week").alias("anchor_week"), F.col("cum_avg").alias("anchor_value")), "app_id")
    return C.extrapolate(a, 40, ["app_id"]).withColumn("cum", F.round("cum", 4))


@query("truncation_test", "C11", f"""WITH {averaged('app_id')}, {smooth_sql('ac', 'app_id', 3, 'WHERE week <= 10')}, {decay_sql('sm', 3, 10, 'app_id')},
 tt AS (SELECT app_id, (SELECT count(*) FROM sb WHERE sb.app_id = df.app_id) AS size, any_value(z.cum_avg) AS actual, any_value(y.cum_avg) + sum(a * pow(r, g.week)) AS predicted
  FROM df JOIN ac y USING (app_id) JOIN ac z USING (app_id) JOIN (SELECT unnest(range(11, 21))::BIGINT AS week) g ON true WHERE y.week = 10 AND z.week = 20 GROUP BY 1),
 te AS (SELECT *, (predicted - actual) / actual AS rel_err, CASE WHEN (SELECT count(*) FROM tt WHERE size >= 100) >= 2 THEN 100 ELSE 50 END AS ms FROM tt)
 SELECT app_id, size, round(actual, 4) AS actual, round(predicted, 4) AS predicted, round(rel_err, 6) AS rel_err, ms::BIGINT AS min_size, round(max(abs(rel_err)) OVER (), 6) AS band FROM te WHERE size >= ms""")
def truncation_test(spark, d):
    subs, pay, now = curve_parts(spark, d)
    c = cut(K.averaged_curve(subs, pay, now, ORDERS, 24, ["app_id"]))
    sizes = subs.groupBy("app_id").agg(F.count(F.lit(1)).alias("size"))
    t = C.truncation_test(c, sizes, 10, 20, ["app_id"])
    return t.withColumns({"actual": F.round("actual", 4), "predicted": F.round("predicted", 4), "rel_err": r6("rel_err"), "band": r6("band")})


@query("ratio_curve", "C12", f"""{GO}, {averaged()}, pl AS (SELECT rebill_number AS week, sum(cumr) / sum(payers) AS sub_ltv FROM cf GROUP BY 1),
 rt AS (SELECT week, n, cum_avg / sub_ltv AS ratio FROM ac JOIN pl USING (week)),
 fl0 AS (SELECT arg_max(ratio, week) FILTER (n >= 40) AS flat FROM rt)
 SELECT g.week, round(coalesce(last_value(ratio IGNORE NULLS) OVER (ORDER BY g.week), flat), 6) AS ratio FROM (SELECT unnest(range(0, {ORDERS.hmax + 1}))::BIGINT AS week) g JOIN fl0 ON true LEFT JOIN rt USING (week)""")
def ratio_curve(spark, d):
    person = K.averaged_curve(*curve_parts(spark, d), ORDERS, 24).withColumnRenamed("cum_avg", "person_ltv")
    sub = K.pooled_curve(facts(spark, d)).select(F.col("rebill_number").alias("week"), F.col("payer_ltv").alias("sub_ltv"))
    return C.ratio_curve(person, sub, ORDERS.hmax).withColumn("ratio", r6("ratio"))
