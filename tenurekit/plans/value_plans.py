"""Projection, roll-ups, older table forms and month-by-month forecasts on the driver's tables."""

from pyspark.sql import functions as F

from tenurekit.functions.exprs import r6
from tenurekit.functions.ordered import cut
from tenurekit.operators import calibrate as C
from tenurekit.operators import cohorts as K
from tenurekit.operators import evaluate as E
from tenurekit.operators import hazard as H
from tenurekit.operators import ladder as L
from tenurekit.operators import ltv as V
from tenurekit.operators import months as M
from tenurekit.operators import population as N
from tenurekit.operators import revenue as R
from tenurekit.operators import survival as S
from tenurekit.params import ORDERS
from tenurekit.params import ORDERS_WEB as P
from tenurekit.plans import sql as Q
from tenurekit.plans.cohort_plans import FITSQL, averaged, curve_parts, decay_sql, ref_hazard, shape, smooth_sql
from tenurekit.plans.evaluate_plans import FOLDS
from tenurekit.plans.hazard_plans import FIT, fitted
from tenurekit.plans.ladder_plans import order_log
from tenurekit.plans.ltv_plans import WHR, cells_sql, is_check, table_sql, web, web_state, week
from tenurekit.plans.registry import query
from tenurekit.plans.revenue_plans import HC, POP, web_log, web_pop
from tenurekit.plans.stages import staged

HZ = ORDERS.report_horizons
#: cohort cells of the web log: anchor at their age, conversion, attach rate, observed money per trial
CELL = f"{WHR}, {cells_sql(['cohort_date'])}, an AS (SELECT cohort_date, anchor, conversion AS share_base, coalesce(share_ups, 0) * conversion AS share_ups, ltv_per_trial_current AS observed FROM cl LEFT JOIN ar USING (cohort_date))"
PAY = f"(share_base * {P.net_base_price} * s + CASE WHEN {is_check('k')} THEN share_ups * {P.net_ups_price} * s ELSE 0 END)"


def cell_parts(spark, d):
    """Curves and anchors of the cohort cells."""
    w = web(spark, d)
    st = web_state(spark, d, w)
    pop, by = N.mature(w.pop, P.min_age), ["cohort_date"]
    ratios = V.cohort_ratios(L.training_rows(w.mx), st, P)
    curves = staged(spark, d, "cohort_curves", lambda: V.cell_curves(w.mx, pop, st, ratios, P, by))
    rates = V.attach_rates(V.checkpoint_observations(w.events, pop, V.base_ladder(w.events, P), P), pop, P, by)
    cells = V.cell_summary(pop, w, P, by).join(rates.select(*by, "share_ups"), by, "left")
    return curves, staged(spark, d, "cohort_anchors", lambda: cells.select(
        *by, "anchor", F.col("conversion").alias("share_base"), (F.coalesce("share_ups", F.lit(0.0)) * F.col("conversion")).alias("share_ups"),
        F.col("ltv_per_trial_current").alias("observed")))


@query("projected_increment", "L1", f"{CELL} SELECT cohort_date, h AS horizon, round(sum({PAY}), 6) AS increment FROM cv JOIN an USING (cohort_date) JOIN (SELECT unnest({list(P.report_horizons)})::BIGINT AS h) g ON k > anchor AND k <= h GROUP BY 1, 2")
def projected_increment(spark, d):
    c, a = cell_parts(spark, d)
    return V.project_increment(c, a, P.report_horizons, P, ["cohort_date"]).withColumn("increment", r6("increment"))


@query("ltv_curve", "L2", f"{CELL} SELECT cohort_date, k, round(observed + sum(CASE WHEN k > anchor THEN {PAY} ELSE 0 END) OVER (PARTITION BY cohort_date ORDER BY k), 6) AS ltv FROM cv JOIN an USING (cohort_date) WHERE k >= anchor")
def ltv_curve(spark, d):
    c, a = cell_parts(spark, d)
    return V.ltv_curve(c, a, P, ["cohort_date"]).withColumn("ltv", r6("ltv"))


@query("table_rollup", "L9", f"""{table_sql(['cohort_date', 'first_funnel'])} SELECT first_funnel, grouping(first_funnel)::BIGINT AS is_total, sum(n_trial)::BIGINT AS n_trial, sum(n_base_payer)::BIGINT AS n_base_payer,
 {', '.join(f"round(sum(n_trial * ltv_per_trial_{n}) / sum(n_trial), 9) AS ltv_per_trial_{n}, round(sum(n_base_payer * ltv_per_base_payer_{n}) / sum(n_base_payer), 9) AS ltv_per_base_payer_{n}, round(sum(ltv_{n}_n_mature) / sum(n_trial), 6) AS share_mature_{n}" for n in (8, 20))}
 FROM tb GROUP BY ROLLUP (first_funnel)""")
def table_rollup(spark, d):
    w = web(spark, d)
    t = V.table_rollup(V.rounded_cells(V.cell_table(w, web_state(spark, d, w), P, ["cohort_date", "first_funnel"])), "first_funnel", (8, 20))
    return t.withColumns({c: (r6(c) if c.startswith("share") else F.round(c, 9)) for c in t.columns if c.startswith(("ltv", "share"))})


@query("forecast_by_age", "L10", f"""{table_sql(['cohort_date', 'first_funnel', 'utm_source'])} SELECT avg_age_weeks, count(*) AS cells, sum(n_trial)::BIGINT AS n_trial, sum(n_base_payer)::BIGINT AS n_base_payer,
 {', '.join(f"round(sum(n_trial * ltv_per_trial_{n}) / sum(n_trial), 9) AS ltv_per_trial_{n}, round(sum(n_base_payer * ltv_per_base_payer_{n}) / nullif(sum(n_base_payer), 0), 9) AS ltv_per_base_payer_{n}" for n in (12, 20))}
 FROM tb GROUP BY 1""")
def forecast_by_age(spark, d):
    w = web(spark, d)
    t = V.by_age(V.rounded_cells(V.cell_table(w, web_state(spark, d, w), P, ["cohort_date", "first_funnel", "utm_source"])), (12, 20))
    return t.withColumns({c: F.round(c, 9) for c in t.columns if c.startswith("ltv")})


@query("observed_by_week", "P18", f"""{POP}, pc AS (SELECT session_id, {week()} AS week, sum(coalesce(amt_net, 0) * {HC!r}) AS net FROM (SELECT session_id, ts, amt_net FROM mo) JOIN pop USING (session_id) GROUP BY 1, 2),
 pm_ AS (SELECT g.week, p.session_id, has_base, coalesce(sum(net), 0) AS c FROM pop p JOIN (SELECT unnest(range(0, 21))::BIGINT AS week) g ON age_weeks_now >= g.week + {P.return_periods}
   LEFT JOIN pc ON pc.session_id = p.session_id AND pc.week <= g.week GROUP BY 1, 2, 3),
 ow AS (SELECT week, count(*) AS n_all, count(*) FILTER (has_base) AS n_base, avg(c) AS a, avg(c) FILTER (has_base) AS b FROM pm_ GROUP BY 1)
 SELECT week, n_all, n_base, round(a, 5) AS ltv_all, round(b, 5) AS ltv_base FROM (SELECT *, min(CASE WHEN n_all >= 1000 THEN 1 ELSE 0 END) OVER (ORDER BY week) AS ok FROM ow) WHERE ok = 1""")
def observed_by_week(spark, d):
    ev, pop = web_log(spark, d), web_pop(spark, d)
    o = V.observed_by_week(pop, R.weekly_net(ev, pop, P), P, 20, 1000)
    return o.withColumns({"ltv_all": F.round("ltv_all", 5), "ltv_base": F.round("ltv_base", 5)})


def first_go(sql: str) -> str:
    return sql.split("WITH ", 1)[1]


RT = f"""{POP}, {first_go(FITSQL).replace(Q.WE + ', ', '', 1)}, pn AS (SELECT session_id, {week()} AS week, sum(CASE WHEN event_type = 'subscription_started' THEN coalesce(amt_net, 0) * {HC!r} ELSE 0 END) AS nb,
   sum(CASE WHEN event_type = 'upsale_converted' THEN coalesce(amt_net, 0) * {HC!r} ELSE 0 END) AS nu FROM (SELECT session_id, ts, amt_net, event_type FROM mo) JOIN pop USING (session_id) GROUP BY 1, 2),
 p2 AS (SELECT *, base_net + ups_net AS tot FROM pop),
 rc_ AS (SELECT cohort_date, utm_source, count(*) AS na, count(*) FILTER (tot > 0) AS np, CAST(floor(avg(age_weeks_now)) AS BIGINT) AS age, avg(base_net) AS cur, avg(tot) AS curu, coalesce(avg(base_net) FILTER (tot > 0), 0) AS curp, coalesce(avg(tot) FILTER (tot > 0), 0) AS curpu FROM p2 GROUP BY 1, 2),
 rh AS (SELECT cohort_date, utm_source, h, p2.session_id, tot > 0 AS pay, coalesce(sum(nb), 0) AS b, coalesce(sum(nb + nu), 0) AS t FROM p2 JOIN (SELECT unnest({list(HZ)})::BIGINT AS h) g ON age_weeks_now >= h
   LEFT JOIN pn ON pn.session_id = p2.session_id AND week <= least(h, (SELECT max(age_weeks_now) FROM pop)) GROUP BY 1, 2, 3, 4, 5),
 rf AS (SELECT cohort_date, utm_source, h, count(*) AS nm, avg(b) AS fb, coalesce(avg(b) FILTER (pay), 0) AS fbp, avg(t) AS ft_, coalesce(avg(t) FILTER (pay), 0) AS ftp FROM rh GROUP BY 1, 2, 3),
 rg AS (SELECT rc_.*, g.h, nm, fb, fbp, ft_, ftp, x.value / y.value AS gr, xu.ups_value / yu.ups_value AS ur FROM rc_ JOIN (SELECT unnest({list(HZ)})::BIGINT AS h) g ON true LEFT JOIN rf ON rf.cohort_date = rc_.cohort_date AND rf.utm_source = rc_.utm_source AND rf.h = g.h
   LEFT JOIN gs x ON x.k = least(g.h, {ORDERS.h_ext}) LEFT JOIN gs y ON y.k = least(greatest(age, 1), {ORDERS.h_ext}) LEFT JOIN gs xu ON xu.k = least(CAST(floor(g.h / 4) AS BIGINT) * 4, {ORDERS.h_ext}) LEFT JOIN gs yu ON yu.k = least(CAST(floor(greatest(age, 1) / 4) AS BIGINT) * 4, {ORDERS.h_ext}))
 SELECT cohort_date, utm_source, h AS horizon, na AS n_attributed, np AS n_payers, age AS avg_age_weeks, np < {ORDERS.low_n} AS low_n, round(CASE WHEN nm IS NULL THEN cur * gr ELSE fb END, 4) AS ltv_per_attributed, round(CASE WHEN nm IS NULL THEN curp * gr ELSE fbp END, 4) AS ltv_per_payer,
  round(CASE WHEN nm IS NULL THEN cur * gr + curu - cur ELSE ft_ END, 4) AS ltv_per_attributed_ups_factonly, round(CASE WHEN nm IS NULL THEN curp * gr + curpu - curp ELSE ftp END, 4) AS ltv_per_payer_ups_factonly,
  round(CASE WHEN nm IS NULL THEN cur * gr + (curu - cur) * ur ELSE ft_ END, 4) AS ltv_per_attributed_ups_projected, round(CASE WHEN nm IS NULL THEN curp * gr + (curpu - curp) * ur ELSE ftp END, 4) AS ltv_per_payer_ups_projected,
  CASE WHEN nm IS NULL THEN 'model' ELSE 'fact' END AS source, coalesce(nm, 0) AS n_mature, CASE WHEN nm IS NULL THEN 'rough_low_data' ELSE 'fact' END AS ups_projection_quality FROM rg"""


@query("ratio_table", "L5 C6 C7", RT)
def ratio_table(spark, d):
    ev, pop = web_log(spark, d), web_pop(spark, d)
    two = pop.withColumn("total_net", F.col("base_net") + F.col("ups_net"))
    wk = R.weekly_net(ev, pop, P, ["session_id"], (R.BASE, R.UPSELL)).withColumn("net_ups", F.col("net") - F.col("net_base"))
    sh = cut(shape(spark, d).select("k", "value", "ups_value"))
    t = V.ratio_table(two, wk, sh, ORDERS, ["cohort_date", "utm_source"], HZ, pop.agg(F.max("age_weeks_now")).scalar())
    return t.withColumns({c: F.round(c, 4) for c in t.columns if c.startswith("ltv_")})


WALK = f"""{FOLDS}, {Q.first_levers('lva', P, 'app_id', 'wf0')}, wf1 AS (SELECT sub_id, max(weeks_obs) AS wo FROM lva GROUP BY 1),
 wf2 AS (SELECT f.app_id AS fold, p.cohort_date, p.first_funnel, w.w AS weeks, f.sub_id, {', '.join('f.' + c for c in P.levers)} FROM wf0 f JOIN wf1 USING (sub_id) JOIN pop p ON p.session_id = f.sub_id AND p.has_base
   JOIN (SELECT unnest([1, 2, 3, 4])::BIGINT AS w) w ON wo >= w.w WHERE f.app_id IN (SELECT fold FROM fo)), {Q.personal('wf2', 'muf', P, 'wf3', 'fold')},
 wf4 AS (SELECT fold, cohort_date, first_funnel, weeks, {', '.join(P.levers)}, count(*) AS w, any_value(mult) AS mult, any_value(coalesce(hr, 1)) AS hr FROM wf3 LEFT JOIN h3 USING (fold, weeks) GROUP BY ALL),
 {Q.curve('wf4', 'hbf', P, 'fold, cohort_date, first_funnel, weeks', 'wfv', P.h_ext, 'fold')},
 wfr AS (SELECT cohort_date, first_funnel, (coalesce(sum(paid_ups), 0) + {P.attach_shrink} * (SELECT avg(paid_ups) FROM ob)) / (count(paid_ups) + {P.attach_shrink}) AS share_ups FROM pop LEFT JOIN ob USING (session_id) WHERE has_base GROUP BY 1, 2),
 wfs AS (SELECT cohort_date, first_funnel, count(*) FILTER (has_base) AS n, CAST(floor(avg(age_weeks_now)) AS BIGINT) AS age FROM pop GROUP BY 1, 2),
 wfn AS (SELECT cohort_date, first_funnel, {week()} AS week, sum(coalesce(amt_net, 0) * {HC!r}) AS net FROM (SELECT session_id, ts, amt_net FROM mo) JOIN pop USING (session_id) WHERE has_base GROUP BY 1, 2, 3),
 wfg AS (SELECT DISTINCT v.cohort_date, v.first_funnel, v.weeks, h.h AS horizon, n, age, (SELECT max(age_weeks_now) FROM pop) AS mw FROM wfv v JOIN (SELECT unnest([4, 8, 12, 20])::BIGINT AS h) h ON true JOIN wfs USING (cohort_date, first_funnel) WHERE v.weeks <= age)
 SELECT cohort_date, first_funnel, weeks, horizon, n, round((SELECT coalesce(sum(net), 0) FROM wfn x WHERE x.cohort_date = g.cohort_date AND x.first_funnel = g.first_funnel AND x.week <= least(weeks, horizon, mw)) / n
   + coalesce((SELECT sum({P.net_base_price} * s + CASE WHEN k >= 2 AND (k - 2) % 4 = 0 THEN share_ups * {P.net_ups_price} * s ELSE 0 END) FROM wfv v JOIN wfr USING (cohort_date, first_funnel) WHERE v.cohort_date = g.cohort_date AND v.first_funnel = g.first_funnel AND v.weeks = g.weeks AND k > g.weeks AND k <= g.horizon), 0), 2) AS ltv,
  round(CASE WHEN horizon <= age AND horizon <= mw THEN (SELECT coalesce(sum(net), 0) FROM wfn x WHERE x.cohort_date = g.cohort_date AND x.first_funnel = g.first_funnel AND x.week <= horizon) / n END, 2) AS fact FROM wfg g"""


@query("walk_forward", "L11 M14", WALK)
def walk_forward(spark, d):
    donor = ref_hazard(spark, d)
    w = web(spark, d)
    folds = S.payers(w.mx).where("payers >= 50")
    st = E.loo_fit(L.training_rows(w.mx), P, folds, donor=donor, splice=True)
    out = E.walk_forward(w, H.State(cut(st.hazard), cut(st.mult)), P, ["cohort_date", "first_funnel"], (1, 2, 3, 4), (4, 8, 12, 20))
    return out.withColumns({"ltv": F.round("ltv", 2), "fact": F.round("fact", 2)})


VIN = f"""{FIT}, vf AS (SELECT sub_id, min(pay_ts) AS f, strftime(date_trunc('quarter', min(pay_ts)), '%Y-%m') AS cohort FROM mx GROUP BY 1), vm AS (SELECT lv.*, f, cohort FROM lv JOIN vf USING (sub_id)),
 vz AS (SELECT vm.* EXCLUDE (weeks_obs), w AS weeks, w::DOUBLE AS weeks_obs FROM vm JOIN (SELECT unnest([1, 2, 4, 8])::BIGINT AS w) g ON weeks_obs >= w AND {Q.days('f', 'pay_ts')} / {ORDERS.period_days} < w),
 {Q.first_levers('vz', ORDERS, 'cohort, weeks', 'vl')}, {Q.personal('vl', 'mu', ORDERS, 'vp')}, vo AS (SELECT * FROM vz WHERE step_k <= weeks), {Q.ratio('vo', 'vp', 'hb', ORDERS, 'cohort, weeks', 'vh')},
 vx AS (SELECT cohort, weeks, geo, media_source, billday_bin, count(*) AS w, any_value(mult) AS mult, any_value(coalesce(hr, 1)) AS hr FROM vp LEFT JOIN vh USING (cohort, weeks) GROUP BY ALL), {Q.curve('vx', 'hb', ORDERS, 'cohort, weeks', 'vc')},
 va AS (SELECT cohort, step_k - 1 AS k, count(*) AS act, sum(amount / 1000) AS rev FROM vm JOIN (SELECT sub_id, tie, amount FROM oe WHERE kind = 'pay') USING (sub_id, tie) GROUP BY 1, 2),
 vt AS (SELECT cohort, k, act / first_value(act) OVER w AS rp, rev / act AS arpu, sum(rev) OVER w / first_value(act) OVER w AS ltv FROM va WINDOW w AS (PARTITION BY cohort ORDER BY k)),
 vs AS (SELECT cohort, weeks, count(*) AS visible_rows, count(DISTINCT sub_id) AS visible_subs FROM vz GROUP BY 1, 2),
 vg AS (SELECT w.cohort, w.weeks, g.k, s, rp, ltv, last_value(arpu IGNORE NULLS) OVER (PARTITION BY w.cohort, w.weeks ORDER BY g.k) AS a FROM vs w JOIN (SELECT unnest(range(0, {ORDERS.hmax + 1}))::BIGINT AS k) g ON true
  LEFT JOIN vc ON vc.cohort = w.cohort AND vc.weeks = w.weeks AND vc.k = g.k LEFT JOIN vt ON vt.cohort = w.cohort AND vt.k = g.k),
 vr AS (SELECT *, sum(CASE WHEN k = 0 THEN a ELSE coalesce(s * a, 0) END) OVER (PARTITION BY cohort, weeks ORDER BY k) AS raw FROM vg),
 vw AS (SELECT cohort, weeks, max(ltv) FILTER (k = weeks) AS anchor_fact, max(raw) FILTER (k = weeks) AS anchor_raw, max(raw) FILTER (k = {ORDERS.hmax}) AS raw_end, avg(abs(s - rp)) FILTER (k BETWEEN 1 AND weeks) AS survival_mae FROM vr GROUP BY 1, 2)
 SELECT cohort, weeks, round(anchor_fact, 3) AS anchor_fact, round(anchor_raw, 3) AS anchor_raw, round(raw_end, 3) AS raw_end, round(survival_mae, 6) AS survival_mae, visible_rows, visible_subs,
  round(anchor_fact / anchor_raw, 6) AS scale, round(raw_end * anchor_fact / anchor_raw, 3) AS anchored_end FROM vw JOIN vs USING (cohort, weeks)"""


@query("vintage_forecasts", "V20 C8 M14", VIN)
def vintage_forecasts(spark, d):
    """Every entry quarter from 1, 2, 4 and 8 visible periods."""
    mx, st = fitted(spark, d)
    entry = mx.groupBy("sub_id").agg(F.date_format(F.date_trunc("quarter", F.min("pay_ts")), "yyyy-MM").alias("cohort"))
    co = mx.join(entry, "sub_id")
    pay = order_log(spark, d).where("kind = 'pay'").select("sub_id", "tie", (F.col("amount") / 1000).alias("amount"))
    out = E.vintage_forecasts(co, st, cut(E.vintage_facts(co, pay, ["cohort"])), ORDERS, (1, 2, 4, 8), ["cohort"])
    money = ("anchor_fact", "anchor_raw", "raw_end", "anchored_end")
    return out.withColumns({c: F.round(c, 3) for c in money} | {"survival_mae": r6("survival_mae"), "scale": r6("scale")})


# ------------------------------------------------------------------ calendar months
MO = f"""WITH {Q.OE}, pa AS (SELECT sub_id, ts, tie, amount / 1000 AS amount, media_source, app_id FROM oe WHERE kind = 'pay'), sb AS (SELECT sub_id, min(ts) AS st, arg_min(app_id, (ts, tie)) AS app_id FROM pa GROUP BY 1)"""
PROV = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def pays(spark, d):
    return order_log(spark, d).where("kind = 'pay'").select("sub_id", "ts", "tie", (F.col("amount") / 1000).alias("amount"), F.col("media_source").alias("provider"))


@query("monthly_revenue", "B1 A12", f"""{MO} SELECT strftime(ts, '%Y-%m') AS month, {', '.join(f"round(coalesce(sum(amount) FILTER (media_source = '{x}'), 0), 5) AS \"{x}\"" for x in PROV)}, round(sum(amount), 5) AS total, count(*) AS payments FROM pa GROUP BY 1""")
def monthly_revenue(spark, d):
    m = M.monthly_revenue(pays(spark, d), PROV)
    return m.withColumns({c: F.round(F.col(f"`{c}`"), 5) for c in (*PROV, "total")})


@query("monthly_starts", "B1", f"{MO} SELECT strftime(st, '%Y-%m') AS month, count(*) AS new_subs FROM sb GROUP BY 1")
def monthly_starts(spark, d):
    return M.monthly_starts(curve_parts(spark, d)[0])


@query("month_reconciliation", "B2 E15", f"""{MO}, qa AS (SELECT sub_id FROM pa GROUP BY 1 HAVING count(*) > 14), mm AS (SELECT media_source, strftime(ts, '%Y-%m') AS month, sum(amount) AS m FROM pa WHERE sub_id NOT IN (SELECT sub_id FROM qa) GROUP BY 1, 2),
 ms AS (SELECT media_source, sum(m) AS total, count(*) AS months FROM mm GROUP BY 1), gr AS (SELECT media_source, sum(amount) AS gross, coalesce(sum(amount) FILTER (sub_id IN (SELECT sub_id FROM qa)), 0) AS excluded FROM pa GROUP BY 1)
 SELECT media_source AS provider, round(gross, 3) AS gross, round(excluded, 3) AS excluded, months, abs(coalesce(total, 0) - (gross - excluded)) <= 0.01 AS ok FROM gr LEFT JOIN ms USING (media_source)""")
def month_reconciliation(spark, d):
    p = pays(spark, d)
    qa = p.groupBy("sub_id").agg(F.count(F.lit(1)).alias("n")).where("n > 14").select("sub_id")
    r = M.reconcile_months(p, qa)
    return r.select("provider", F.round("gross", 3).alias("gross"), F.round("excluded", 3).alias("excluded"), "months", "ok")


@query("month_growth", "B3 W2", f"{MO}, mm AS (SELECT strftime(ts, '%Y-%m') AS month, sum(amount) AS total FROM pa GROUP BY 1) SELECT month, round(total, 5) AS total, round((total - lag(total) OVER (ORDER BY month)) / lag(total) OVER (ORDER BY month), 6) AS growth FROM mm")
def month_growth(spark, d):
    g = M.month_growth(M.monthly_revenue(pays(spark, d), PROV).select("month", "total"))
    return g.withColumns({"total": F.round("total", 5), "growth": r6("growth")})


AT = "1999-01-01"
ALIVE = f"""{MO}, lp AS (SELECT sub_id, max(ts) AS lp FROM oe WHERE kind = 'pay' AND ts < TIMESTAMP '{AT}' GROUP BY 1),
 dd AS (SELECT sub_id, min(ts) AS dt FROM oe JOIN lp USING (sub_id) WHERE kind = 'vol' AND ts > lp AND ts < TIMESTAMP '{AT}' GROUP BY 1),
 al AS (SELECT sb.sub_id, st, greatest(CAST(floor({Q.days('st', f"TIMESTAMP '{AT}'")} / {ORDERS.period_days}) AS BIGINT), 0) AS week_now, dt IS NULL OR dt >= TIMESTAMP '{AT}' AS alive FROM sb LEFT JOIN dd USING (sub_id) WHERE st < TIMESTAMP '{AT}')"""


def alive(spark, d):
    """A death is the first cancellation after the last payment, as known at the cutoff."""
    ev = order_log(spark, d).where(F.col("ts") < F.lit(AT).cast("timestamp"))
    last = ev.where("kind = 'pay'").groupBy("sub_id").agg(F.max("ts").alias("last_pay"))
    dead = ev.where("kind = 'vol'").join(last, "sub_id").where("ts > last_pay").select("sub_id", F.col("ts").alias("death_ts"))
    return M.alive_table(curve_parts(spark, d)[0], dead, F.lit(AT).cast("timestamp"), ORDERS)


@query("alive_table", "B4 E27", f"{ALIVE} SELECT sub_id, week_now, alive FROM al")
def alive_table(spark, d):
    return alive(spark, d).select("sub_id", "week_now", "alive")


MONTHS = [f"1999-{m:02d}" for m in range(1, 7)]
INC = f"""{ALIVE}, sa AS{averaged().split(' sa AS', 1)[1]}, {smooth_sql('ac')}, {decay_sql('sm', 8, 16)},
 ob AS (SELECT week, cum_avg - lag(cum_avg) OVER (ORDER BY week) AS i0, CASE WHEN week = 0 THEN cum_avg END AS w0 FROM ac),
 inc AS (SELECT g.week, CASE WHEN g.week <= 16 AND i0 IS NOT NULL THEN greatest(i0, 0) ELSE a * pow(r, g.week) END AS inc, CASE WHEN g.week = 0 THEN w0 WHEN g.week <= 16 AND i0 IS NOT NULL THEN greatest(i0, 0) ELSE a * pow(r, g.week) END AS inc0
  FROM (SELECT unnest(range(0, 40))::BIGINT AS week) g JOIN df ON true LEFT JOIN ob USING (week))"""


def increments(spark, d, week0=False):
    c = cut(K.averaged_curve(*curve_parts(spark, d), ORDERS, 24))
    fit = C.decay_fit(C.smoothed_increments(c), 8, 16)
    return M.increments(c, fit, 16, 40, week0)


@query("increment_table", "B5", f"{INC} SELECT week, round(inc, 5) AS inc, round(inc0, 5) AS inc0 FROM inc")
def increment_table(spark, d):
    a = increments(spark, d).select("week", F.round("inc", 5).alias("inc"))
    return a.join(increments(spark, d, True).select("week", F.round("inc", 5).alias("inc0")), "week")


BASEP = f"""{INC}, bp AS (SELECT strftime(st + to_days(CAST(week * {int(ORDERS.period_days)} AS INTEGER)), '%Y-%m') AS month, sum(inc) AS amount FROM al JOIN inc ON week > week_now AND week < 40 WHERE alive GROUP BY 1),
 mn AS (SELECT unnest({MONTHS}) AS month), bm AS (SELECT month, coalesce(amount, 0) AS amount FROM mn LEFT JOIN bp USING (month))"""


@query("base_projection", "B6", f"{BASEP} SELECT month, round(amount, 3) AS amount FROM bm")
def base_projection(spark, d):
    return M.project_base(alive(spark, d), increments(spark, d), MONTHS, ORDERS, 40).withColumn("amount", F.round("amount", 3))


SCEN = {"stopped": {m: 0 for m in MONTHS}, "flat": {m: 100 for m in MONTHS}, "growth": {m: 100 * 1.2 ** i for i, m in enumerate(MONTHS)}}
SCV = ", ".join(f"('{s}', '{m}', {n!r}::DOUBLE)" for s, x in SCEN.items() for m, n in x.items())


@query("acquisition_projection", "B7", f"""{INC}, sc AS (SELECT * FROM (VALUES {SCV}) v(scenario, start_month, new_subs)), mn AS (SELECT unnest({MONTHS}) AS month),
 ap AS (SELECT scenario, strftime(CAST(start_month || '-01' AS DATE) + to_days(CAST(15 + week * {int(ORDERS.period_days)} AS INTEGER)), '%Y-%m') AS month, sum(new_subs * inc0) AS amount FROM sc JOIN inc ON week < 20 GROUP BY 1, 2)
 SELECT s.scenario, mn.month, round(coalesce(amount, 0), 3) AS amount FROM (SELECT DISTINCT scenario FROM sc) s JOIN mn ON true LEFT JOIN ap ON ap.scenario = s.scenario AND ap.month = mn.month""")
def acquisition_projection(spark, d):
    return M.project_acquisition(spark, SCEN, increments(spark, d, True), MONTHS, ORDERS).withColumn("amount", F.round("amount", 3))


@query("projection_backtest", "B8", f"""{BASEP}, ac_ AS (SELECT sum(amount) AS actual FROM pa WHERE sub_id IN (SELECT sub_id FROM al) AND strftime(ts, '%Y-%m') IN ({', '.join(repr(m) for m in MONTHS)}))
 SELECT round(sum(amount), 3) AS predicted, round(any_value(actual), 3) AS actual, round((sum(amount) - any_value(actual)) / any_value(actual), 6) AS error, abs((sum(amount) - any_value(actual)) / any_value(actual)) <= 0.25 AS ok FROM bm, ac_""")
def projection_backtest(spark, d):
    a = alive(spark, d)
    b = M.backtest(M.project_base(a, increments(spark, d), MONTHS, ORDERS, 40), pays(spark, d), a, MONTHS)
    return b.withColumns({"predicted": F.round("predicted", 3), "actual": F.round("actual", 3), "error": r6("error")})
