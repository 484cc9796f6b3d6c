"""Web model and money on the driver's tables."""

from pyspark.sql import functions as F

from tenurekit.functions.exprs import r6
from tenurekit.functions.ordered import cut
from tenurekit.operators import hazard as H
from tenurekit.operators import ladder as L
from tenurekit.operators import ltv as V
from tenurekit.params import ORDERS
from tenurekit.params import ORDERS_WEB as P
from tenurekit.plans import sql as Q
from tenurekit.plans.ladder_plans import orders_mx
from tenurekit.plans.registry import query
from tenurekit.plans.revenue_plans import HC, POP, web_log, web_pop
from tenurekit.plans.stages import staged

SETTLE = 2  # ceil(return_days / period_days) of P

WMX = f"""{POP}, wk AS (SELECT *, CASE WHEN event_type = 'subscription_started' AND coalesce(round(amt, 2) <> {P.trial_price}::DOUBLE, true) THEN 'pay'
   WHEN event_type = 'billing_issue' THEN 'issue' WHEN event_type = 'sub_cancelled' THEN 'vol' ELSE 'other' END AS kind
  FROM lo WHERE session_id IN (SELECT session_id FROM pop)),
 {Q.steps('wk', P, 'session_id')}, {Q.interval('session_id')},
 tr AS (SELECT session_id, min(ts) AS ft FROM wk WHERE event_type = 'trial_started' GROUP BY 1),
 wmx AS (SELECT st.session_id AS sub_id, step_k, 'active' AS state_from, {Q.outcome(P)} AS outcome, {Q.days('first_pay', '(SELECT max(ts) FROM lo)')} / {P.period_days} AS weeks_obs,
   st.ts AS pay_ts, days_to_next, CAST(cohort_date AS VARCHAR) AS app_id, geo, utm_source AS media_source, '(none)' AS attribution_source,
   coalesce(plan_interval, 'unknown') AS plan_interval, {Q.whole('ft', 'first_pay')} AS trial_days, strftime(cohort_date, '%Y-%m') AS cohort_month,
   day(st.ts) AS billing_day_of_month, day(first_pay) AS first_billing_day, first_funnel AS funnel,
   {Q.whole('st.ts', '(SELECT max(ts) FROM lo)')} >= {P.return_days} AS evaluable, cohort_date, utm_source,
   CASE WHEN outcome IN ('renewed', 'recovered') THEN 1 ELSE 0 END AS survived, CASE WHEN outcome IN ('renewed', 'recovered') THEN 0 ELSE 1 END AS died
  FROM st JOIN pop USING (session_id) LEFT JOIN pi USING (session_id) LEFT JOIN tr USING (session_id)),
 tr_rows AS (SELECT * FROM wmx WHERE evaluable)"""
WMX = WMX.replace("WITH ", "WITH ", 1)

# donor hazard: the mobile-style matrix of the same orders
_mob = Q.mobile_mx("oe", ORDERS)
for a in ("pay", "kept", "fl", "st", "pi", "lev", "mx"):
    _mob = _mob.replace(f" {a} AS (", f" d_{a} AS (").replace(f"FROM {a} ", f"FROM d_{a} ").replace(f"JOIN {a} ", f"JOIN d_{a} {a} ")
_mob = _mob.replace("FROM st JOIN", "FROM d_st st JOIN").replace("FROM d_st JOIN", "FROM d_st st JOIN").replace("FROM d_kept k", "FROM d_kept k").replace("JOIN d_fl fl ON", "JOIN d_fl fl ON")
DONOR = f"{Q.OE}, {_mob}, {Q.hbase('d_mx', ORDERS, 'dn')}"

SPLICE = f"""{Q.hbase('tr_rows', P, 'ow')},
 km AS (SELECT max(step_k) AS km FROM ow WHERE votes >= {P.min_cohorts} AND step_k <= {P.hmax}),
 sm AS (SELECT km, CASE WHEN d.h > 0 THEN o.h / d.h ELSE 1 END AS seam FROM km JOIN ow o ON o.step_k = km LEFT JOIN dn d ON d.step_k = km),
 sraw AS (SELECT k AS step_k, km, CASE WHEN k <= km THEN o.h ELSE d.h * seam END AS h FROM (SELECT unnest(range(1, {P.h_ext + 1}))::BIGINT AS k) g
  JOIN sm ON true LEFT JOIN ow o ON o.step_k = k LEFT JOIN dn d ON d.step_k = k),
 hb AS (SELECT step_k, km AS k_max, coalesce(last_value(h IGNORE NULLS) OVER (ORDER BY step_k),
   first_value(h IGNORE NULLS) OVER (ORDER BY step_k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS h FROM sraw)"""
WFIT = f"{WMX}, {DONOR}, {SPLICE}, {Q.levered('tr_rows', P)}, {Q.multipliers('lv', 'hb', P)}"
WHR = f"{WFIT}, {Q.first_levers('lv', P, 'app_id')}, {Q.personal('fl1', 'mu', P, 'pm')}, {Q.ratio('lv', 'pm', 'hb', P, 'app_id')}"


def web(spark, d) -> V.Web:
    ev, pop = web_log(spark, d), web_pop(spark, d)
    mx = staged(spark, d, "web_matrix", lambda: L.web_matrix(ev, pop, P))
    return V.Web(ev, pop, mx, pop.agg(F.max("age_weeks_now")).scalar())


def web_state(spark, d, w: V.Web) -> H.State:
    train = L.training_rows(w.mx)
    h = staged(spark, d, "web_hazard", lambda: H.splice_hazard(
        H.portfolio_hazard(train, P), P, H.portfolio_hazard(orders_mx(spark, d), ORDERS)))
    return H.State(h, staged(spark, d, "web_multipliers", lambda: H.residual_multipliers(H.clean_cells(train, P), h, P)))


@query("web_matrix", "M10 M11 M7", f"""{WMX} SELECT sub_id, step_k, outcome, round(weeks_obs, 6) AS weeks_obs, round(days_to_next, 6) AS days_to_next, app_id, geo, media_source,
 plan_interval, trial_days, cohort_month, billing_day_of_month, funnel, evaluable FROM wmx""")
def web_matrix(spark, d):
    mx = web(spark, d).mx
    return mx.select("sub_id", "step_k", "outcome", r6("weeks_obs").alias("weeks_obs"), r6("days_to_next").alias("days_to_next"), "app_id", "geo",
                     "media_source", "plan_interval", "trial_days", "cohort_month", "billing_day_of_month", "funnel", "evaluable")


@query("web_hazard", "H3 M11", f"{WMX}, {DONOR}, {SPLICE} SELECT step_k, k_max, round(h, 6) AS h FROM hb")
def web_hazard(spark, d):
    w = web(spark, d)
    return web_state(spark, d, w).hazard.select("step_k", "k_max", r6("h").alias("h"))


@query("web_multipliers", "H6", f"{WFIT} SELECT lever, raw, cat, round(mult, 6) AS mult, n FROM mu")
def web_multipliers(spark, d):
    w = web(spark, d)
    return web_state(spark, d, w).mult.select("lever", "raw", "cat", r6("mult").alias("mult"), "n")


@query("cohort_ratios", "H9", f"{WHR} SELECT app_id, n_seen::BIGINT AS n_seen, round(hr, 6) AS hr FROM hr")
def cohort_ratios(spark, d):
    w = web(spark, d)
    return V.cohort_ratios(L.training_rows(w.mx), web_state(spark, d, w), P).select("app_id", "n_seen", r6("hr").alias("hr"))


LADDER = f"""lp AS (SELECT session_id, ts, tie, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, tie) AS pv FROM lo
  WHERE event_type = 'subscription_started' AND coalesce(round(amt, 2) <> {P.trial_price}::DOUBLE, true)),
 ld AS (SELECT session_id, ts FROM lp WHERE pv IS NULL OR {Q.days('pv', 'ts')} > {P.dedup_days})"""


def week(c: str = "ts") -> str:
    return f"greatest(CAST(floor({Q.whole('first_date', c)} / {P.period_days}) AS BIGINT), 0)"


CHECK = f"""{LADDER}, pm1 AS (SELECT * FROM pop WHERE age_weeks_now >= {P.min_age}),
 bw AS (SELECT DISTINCT session_id, {week()} AS week FROM ld JOIN pm1 USING (session_id)),
 uw AS (SELECT DISTINCT session_id, {week()} AS week FROM lo JOIN pm1 USING (session_id) WHERE event_type = 'upsale_converted'),
 ob AS (SELECT b.session_id, b.week, CASE WHEN u.week IS NULL THEN 0 ELSE 1 END AS paid_ups FROM bw b JOIN pm1 USING (session_id) LEFT JOIN uw u USING (session_id, week)
  WHERE b.week BETWEEN {P.ups_first} AND {P.h_ext} AND (b.week - {P.ups_first}) % {P.ups_every} = 0 AND age_weeks_now >= b.week + {SETTLE})"""


def rates_sql(dims: str) -> str:
    return f"""ar AS (SELECT {dims}, count(ob.session_id) AS n_obs, (coalesce(sum(paid_ups), 0) + {P.attach_shrink} * coalesce((SELECT avg(paid_ups) FROM ob), 0)) / (count(ob.session_id) + {P.attach_shrink}) AS share_ups
   FROM pm1 LEFT JOIN ob USING (session_id) WHERE has_base GROUP BY {dims})"""


@query("weekly_payers", "P16 U2", f"""{POP}, {LADDER} SELECT cohort_date, {week()} AS week, count(DISTINCT session_id) AS payers FROM ld JOIN pop USING (session_id)
 WHERE {week()} <= {P.h_ext} GROUP BY 1, 2""")
def weekly_payers(spark, d):
    ev = web_log(spark, d)
    return V.weekly_payers(V.base_ladder(ev, P), web_pop(spark, d), P, ["cohort_date"])


@query("checkpoint_observations", "H18", f"{POP}, {CHECK} SELECT session_id, week, paid_ups::BIGINT AS paid_ups FROM ob")
def checkpoint_observations(spark, d):
    ev = web_log(spark, d)
    pop = web_pop(spark, d).where(F.col("age_weeks_now") >= P.min_age)
    return V.checkpoint_observations(ev, pop, V.base_ladder(ev, P), P)


@query("attach_rates", "H19", f"{POP}, {CHECK}, {rates_sql('cohort_date')} SELECT cohort_date, n_obs, round(share_ups, 6) AS share_ups FROM ar")
def attach_rates(spark, d):
    ev = web_log(spark, d)
    pop = (web_pop(spark, d).where(F.col("age_weeks_now") >= P.min_age))
    obs = cut(V.checkpoint_observations(ev, pop, V.base_ladder(ev, P), P))
    return V.attach_rates(obs, pop, P, ["cohort_date"]).select("cohort_date", "n_obs", r6("share_ups").alias("share_ups"))


def cells_sql(dims: list[str]) -> str:
    """Members from the state to cell curves: cl (cells), ar, nw (weekly net), cv (curves)."""
    ds = ", ".join(dims)
    return f"""{CHECK}, {rates_sql(ds)}, mw AS (SELECT max(age_weeks_now) AS max_week FROM pop),
 cl0 AS (SELECT {ds}, count(*) AS n_trial, count(*) FILTER (has_base) AS n_base_payer, CAST(floor(avg(age_weeks_now)) AS BIGINT) AS avg_age_weeks, sum(total_net) AS revenue_observed,
   avg(total_net) AS ltv_per_trial_current, coalesce(avg(total_net) FILTER (has_base), 0) AS ltv_per_base_payer_current,
   avg(base_net) AS ltv_per_trial_current_base, coalesce(avg(base_net) FILTER (has_base), 0) AS ltv_per_base_payer_current_base,
   {', '.join(f"count(*) FILTER (has_base AND age_weeks_now >= {n} + {P.return_periods}) AS nm_{n}" for n in P.report_horizons)}
  FROM pm1 GROUP BY {ds}),
 cl AS (SELECT *, n_base_payer / n_trial AS conversion, least(avg_age_weeks, max_week) AS anchor, greatest(0, least(avg_age_weeks - {SETTLE}, max_week)) AS fact_until FROM cl0 JOIN mw ON true),
 nw AS (SELECT {ds}, {week()} AS week, sum(coalesce(amt_net, 0) * {HC!r}) AS net, sum(CASE WHEN event_type = 'subscription_started' THEN coalesce(amt_net, 0) * {HC!r} ELSE 0 END) AS net_base
  FROM (SELECT session_id, ts, amt_net, event_type FROM mo) JOIN (SELECT * FROM pm1 WHERE has_base) USING (session_id) GROUP BY ALL),
 {Q.levered('wmx', P, 'lva')},
 fc AS (SELECT {', '.join('p.' + x for x in dims)}, l.sub_id, {', '.join(f"arg_min(l.{'billday_first' if c == 'billday_bin' else c}, step_k) AS l_{c}" for c in P.levers)}
  FROM lva l JOIN pm1 p ON p.session_id = l.sub_id WHERE has_base GROUP BY ALL),
 fq AS (SELECT f.*, least(greatest({' * '.join(f'coalesce(t{i}.mult, 1)' for i in range(len(P.levers)))}, 0.4), 2.5) AS mult, coalesce(hr, 1) AS hr FROM fc f
  {' '.join(f"LEFT JOIN mu t{i} ON t{i}.lever = '{c}' AND t{i}.raw = f.l_{c}" for i, c in enumerate(P.levers))} LEFT JOIN hr ON hr.app_id = CAST({'f.' + dims[0]} AS VARCHAR)),
 fm AS (SELECT {ds}, {', '.join('l_' + c for c in P.levers)}, count(*) AS w, any_value(mult) AS mult, any_value(hr) AS hr FROM fq GROUP BY ALL),
 {Q.curve('fm', 'hb', P, ds, 'cv', P.h_ext)}"""


def is_check(k: str) -> str:
    return f"({k} >= {P.ups_first} AND ({k} - {P.ups_first}) % {P.ups_every} = 0)"


def table_sql(dims: list[str]) -> str:
    ds = ", ".join(dims)
    on = f"USING ({ds})"
    parts = [f"sum(CASE WHEN week <= anchor THEN net ELSE 0 END) / any_value(n_base_payer) AS obs, sum(CASE WHEN week <= anchor THEN net_base ELSE 0 END) / any_value(n_base_payer) AS obs_b"]
    parts += [f"sum(CASE WHEN week <= least({n}, max_week) THEN net ELSE 0 END) / any_value(n_base_payer) AS f_{n}, sum(CASE WHEN week <= least({n}, max_week) THEN net_base ELSE 0 END) / any_value(n_base_payer) AS fb_{n}" for n in P.report_horizons]
    inc = [f"coalesce(sum(s) FILTER (k > anchor AND k <= {n}), 0) AS s_{n}, coalesce(sum(s) FILTER (k > anchor AND k <= {n} AND {is_check('k')}), 0) AS u_{n}" for n in P.report_horizons]
    cols = []
    for n in P.report_horizons:
        full = f"CASE WHEN nc IS NULL THEN ltv_per_base_payer_current WHEN {n} <= anchor THEN f_{n} ELSE obs + {P.net_base_price} * s_{n} + share_ups * {P.net_ups_price} * u_{n} END"
        base = f"CASE WHEN nc IS NULL THEN ltv_per_base_payer_current_base WHEN {n} <= anchor THEN fb_{n} ELSE obs_b + {P.net_base_price} * s_{n} END"
        cols.append(f"""round({full}, 2) AS ltv_per_base_payer_{n}, round({base}, 2) AS ltv_per_base_payer_{n}_base,
 round(CASE WHEN nc IS NULL THEN ltv_per_trial_current ELSE ({full}) * conversion END, 2) AS ltv_per_trial_{n}, round(CASE WHEN nc IS NULL THEN ltv_per_trial_current_base ELSE ({base}) * conversion END, 2) AS ltv_per_trial_{n}_base,
 CASE WHEN nc IS NULL THEN 'no_payers' WHEN {n} <= anchor THEN 'fact' ELSE 'model' END AS ltv_{n}_source, CASE WHEN nc IS NULL THEN 0 ELSE nm_{n} END AS ltv_{n}_n_mature,
 CASE WHEN nc IS NULL THEN 'none' WHEN {n} <= (SELECT max(k_max) FROM hb) THEN 'web_data' ELSE 'ios_tail_extrapolation' END AS ltv_{n}_evidence""")
    return f"""{WHR}, {cells_sql(dims)}, sn AS (SELECT {ds}, {', '.join(parts)} FROM nw JOIN cl {on} GROUP BY {ds}),
 ic AS (SELECT {ds}, count(*) AS nc, {', '.join(inc)} FROM cv JOIN cl {on} GROUP BY {ds}),
 tb AS (SELECT {ds}, n_trial, n_base_payer, round(conversion, 4) AS conversion, avg_age_weeks, n_base_payer < {P.low_n} AS low_n, round(coalesce(hr, 1), 4) AS hr_cohort,
  round(CASE WHEN nc IS NULL THEN 0 ELSE share_ups END, 4) AS ups_attach_rate, round(revenue_observed, 2) AS revenue_observed, round(ltv_per_trial_current, 2) AS ltv_per_trial_current,
  round(ltv_per_base_payer_current, 2) AS ltv_per_base_payer_current, round(ltv_per_trial_current_base, 2) AS ltv_per_trial_current_base, round(ltv_per_base_payer_current_base, 2) AS ltv_per_base_payer_current_base,
  {', '.join(cols)} FROM cl LEFT JOIN sn {on} LEFT JOIN ic {on} LEFT JOIN ar {on} LEFT JOIN hr ON hr.app_id = CAST(cohort_date AS VARCHAR))"""


TABLES = {"utm": ["cohort_date", "utm_source"], "funnel": ["cohort_date", "first_funnel"],
          "funnel_utm": ["cohort_date", "first_funnel", "utm_source"]}


def _table(dims):
    def run(spark, d):
        w = web(spark, d)
        return V.rounded_cells(V.cell_table(w, web_state(spark, d, w), P, dims))
    return run


for _name, _dims in TABLES.items():
    query(f"cell_table_{_name}", "L3 L4 L1 L2 X15", f"{table_sql(_dims)} SELECT * FROM tb")(_table(_dims))


def curve_sql(dims: list[str]) -> str:
    ds = ", ".join(dims)
    return f"""{WHR}, {cells_sql(dims)},
 pb_ AS (SELECT {ds}, {week()} AS week, count(DISTINCT session_id) AS ob FROM ld JOIN (SELECT * FROM pm1 WHERE has_base) USING (session_id) GROUP BY ALL),
 pu_ AS (SELECT {ds}, {week()} AS week, count(DISTINCT session_id) AS ou FROM (SELECT session_id, ts, event_type FROM mo) JOIN (SELECT * FROM pm1 WHERE has_base) USING (session_id) WHERE event_type = 'upsale_converted' GROUP BY ALL),
 sc AS (SELECT {ds}, CASE WHEN fact_until >= 1 AND n_base_payer * s > 0 AND coalesce(ob, 0) > 0 THEN ob / (n_base_payer * s) ELSE 1 END AS scale, true AS has
  FROM cl JOIN cv USING ({ds}) LEFT JOIN pb_ p USING ({ds}) WHERE k = greatest(fact_until, 1) AND (p.week IS NULL OR p.week = greatest(fact_until, 1))),
 hc AS (SELECT {ds}, true AS has FROM cv GROUP BY ALL),
 s1 AS (SELECT {ds}, n_base_payer * s AS md FROM cl JOIN cv USING ({ds}) WHERE k = fact_until),
 s2 AS (SELECT {ds}, ob AS seen FROM cl JOIN pb_ USING ({ds}) WHERE week = fact_until),
 gr AS (SELECT cl.*, g.week, ob, ou, net, s, share_ups, coalesce(has, false) AS has, CASE WHEN fact_until >= 1 AND md > 0 AND seen > 0 THEN seen / md ELSE 1 END AS scale
  FROM cl JOIN (SELECT unnest(range(0, {P.h_ext + 1}))::BIGINT AS week) g ON true LEFT JOIN hc USING ({ds}) LEFT JOIN s1 USING ({ds}) LEFT JOIN s2 USING ({ds}) LEFT JOIN ar USING ({ds})
  LEFT JOIN pb_ ON {' AND '.join(f'pb_.{x} = cl.{x}' for x in dims)} AND pb_.week = g.week LEFT JOIN pu_ ON {' AND '.join(f'pu_.{x} = cl.{x}' for x in dims)} AND pu_.week = g.week
  LEFT JOIN nw ON {' AND '.join(f'nw.{x} = cl.{x}' for x in dims)} AND nw.week = g.week LEFT JOIN cv ON {' AND '.join(f'cv.{x} = cl.{x}' for x in dims)} AND cv.k = g.week),
 rb_ AS (SELECT *, CASE WHEN week <= fact_until THEN coalesce(ob, 0) WHEN NOT has THEN 0 ELSE n_base_payer * s * scale END AS rb FROM gr),
 ru_ AS (SELECT *, CASE WHEN week <= fact_until THEN coalesce(ou, 0) WHEN NOT has THEN 0 WHEN {is_check('week')} THEN rb * share_ups ELSE 0 END AS ru,
   CASE WHEN n_base_payer = 0 THEN 0 WHEN week <= anchor THEN coalesce(net, 0) WHEN has THEN n_base_payer * ({P.net_base_price} * s + CASE WHEN {is_check('week')} THEN share_ups * {P.net_ups_price} * s ELSE 0 END) ELSE 0 END AS money FROM rb_),
 wc0 AS (SELECT {ds}, week, n_base_payer, CASE WHEN n_base_payer >= 300 THEN 'reliable' WHEN n_base_payer >= 100 THEN 'directional' WHEN n_base_payer >= 30 THEN 'rough' ELSE 'insufficient' END AS sample_grade,
  round(rb, 4) AS rebills_base, round(ru, 4) AS rebills_ups, round(sum(rb) OVER w, 4) AS rebills_base_cum, round(sum(ru) OVER w, 4) AS rebills_ups_cum,
  CASE WHEN n_base_payer > 0 THEN round(rb / n_base_payer, 6) ELSE 0 END AS active_share, round(sum(money) OVER w, 2) AS revenue_cum,
  CASE WHEN week <= fact_until THEN 'fact' WHEN NOT has THEN 'no_payers' ELSE 'model' END AS source,
  CASE WHEN week <= (SELECT max(k_max) FROM hb) THEN 'web_data' ELSE 'ios_tail_extrapolation' END AS evidence
  FROM ru_ WINDOW w AS (PARTITION BY {ds} ORDER BY week)),
 wc AS (SELECT *, round(revenue_cum - coalesce(lag(revenue_cum) OVER (PARTITION BY {ds} ORDER BY week), 0), 2) AS revenue_week FROM wc0)"""


CURVES = {"geo": ["cohort_date", "geo"], "campaign": ["cohort_date", "campaign_name"], "ad": ["cohort_date", "ad_name"],
          "full": ["cohort_date", "first_funnel", "utm_source", "geo", "campaign_name", "ad_name"]}


def _curve(dims):
    def run(spark, d):
        w = web(spark, d)
        return V.weekly_curve(w, web_state(spark, d, w), P, dims)
    return run


for _name, _dims in CURVES.items():
    query(f"weekly_curve_{_name}", "L6 L7 L8 W10", f"{curve_sql(_dims)} SELECT * FROM wc")(_curve(_dims))
