"""Accuracy tests on the driver's tables."""

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.functions.exprs import r6
from tenurekit.functions.ordered import cut
from tenurekit.operators import cohorts as K
from tenurekit.operators import evaluate as E
from tenurekit.operators import hazard as H
from tenurekit.operators import survival as S
from tenurekit.params import ORDERS as P
from tenurekit.params import ORDERS_WEB as PW
from tenurekit.plans import sql as Q
from tenurekit.plans.cohort_plans import FITSQL, facts, golden, members, ref_hazard
from tenurekit.plans.hazard_plans import COMBO, EMP, FIT, HB, MIX, WEEKS, fitted
from tenurekit.plans.ladder_plans import OMX, orders_mx
from tenurekit.plans.ltv_plans import CHECK, DONOR, WMX, web, week
from tenurekit.plans.registry import query
from tenurekit.plans.stages import staged
from tenurekit.plans.revenue_plans import HC

EMPM = EMP.split(HB, 1)[1]
PRED = f"""{MIX}{COMBO}, {Q.curve('mix', 'hb', P, 'app_id, weeks')}{EMPM}, {Q.survival('mx', P)},
 prd AS (SELECT 'map' AS model, app_id, weeks, k, s FROM cv UNION ALL SELECT 'empirical', app_id, weeks, k, s FROM ec),
 sc AS (SELECT model, app_id, weeks, k AS horizon, mature, fact, s, (s - fact) / fact AS signed_err, abs(s - fact) / fact AS abs_err
  FROM prd JOIN ds USING (app_id, k) JOIN cr USING (app_id) WHERE NOT crash AND mature >= {P.min_mature} AND fact > 0 AND k IN {P.horizons}),
 ag AS (SELECT model, weeks, horizon, median(abs_err) AS abs_err, median(signed_err) AS signed_err, count(*) AS n FROM sc GROUP BY 1, 2, 3)"""


def scored(spark, d):
    mx, st = fitted(spark, d)
    return mx, st, staged(spark, d, "model_scores", lambda: E.score(E.all_models(mx, st, P), S.app_facts(mx, P), P))


def grid_out(g):
    return g.withColumns({"abs_err": r6("abs_err"), "signed_err": r6("signed_err")})


@query("accuracy_detail", "V1", f"{PRED} SELECT model, app_id, weeks, horizon, round(fact, 6) AS fact, round(s, 6) AS s, round(abs_err, 6) AS abs_err, round(signed_err, 6) AS signed_err FROM sc")
def accuracy_detail(spark, d):
    s = scored(spark, d)[2]
    return s.select("model", "app_id", "weeks", "horizon", *[r6(c).alias(c) for c in ("fact", "s", "abs_err", "signed_err")])


@query("accuracy_grid", "V1 A4", f"{PRED} SELECT model, weeks, horizon, round(abs_err, 6) AS abs_err, round(signed_err, 6) AS signed_err, n FROM ag")
def accuracy_grid(spark, d):
    return grid_out(E.accuracy_grid(scored(spark, d)[2]))


@query("model_winners", "V2", f"{PRED}, mo2 AS (SELECT model, horizon, median(abs_err) AS err FROM ag GROUP BY 1, 2) SELECT horizon, arg_min(model, (err, model)) AS winner, round(min(err), 6) AS err FROM mo2 GROUP BY 1")
def model_winners(spark, d):
    return E.winners(E.accuracy_grid(scored(spark, d)[2])).withColumn("err", r6("err"))


LOO = f"""{PRED}, fo AS (SELECT app_id AS fold FROM cr WHERE NOT crash), mxf AS (SELECT fold, mx.* FROM mx JOIN fo ON app_id <> fold),
 {Q.hbase('mxf', P, 'hbf', 'fold, ')}, lvf AS (SELECT fold, lv.* FROM lv JOIN fo ON app_id <> fold), {Q.multipliers('lvf', 'hbf', P, 'muf', 'crx', by='fold, ')},
 flf AS (SELECT *, app_id AS fold FROM fl1 WHERE app_id IN (SELECT fold FROM fo)), {Q.personal('flf', 'muf', P, 'pmf', 'fold')}, lvx AS (SELECT *, app_id AS fold FROM lv),
 {Q.ratio('lvx', 'pmf', 'hbf', P, 'fold', 'hrf', WEEKS, 'fold')},
 mixf AS (SELECT fold, weeks, geo, media_source, billday_bin, count(*) AS w, any_value(mult) AS mult, any_value(hr) AS hr FROM pmf JOIN hrf USING (fold) GROUP BY ALL),
 {Q.curve('mixf', 'hbf', P, 'fold, weeks', 'cvf', hby='fold')},
 scl AS (SELECT app_id, weeks, k AS horizon, s, fact, (s - fact) / fact AS signed_err, abs(s - fact) / fact AS abs_err FROM (SELECT *, fold AS app_id FROM cvf) JOIN ds USING (app_id, k) JOIN cr USING (app_id)
  WHERE NOT crash AND mature >= {P.min_mature} AND fact > 0 AND k IN {P.horizons})"""


def loo_scored(spark, d):
    return staged(spark, d, "loo_scores", lambda: _loo_scored(spark, d))


def _loo_scored(spark, d):
    mx = orders_mx(spark, d)
    apps = cut(S.select_apps(mx, P))
    st = E.loo_fit(mx, P, apps.where("not crash").select("app_id"), apps.where("crash"))
    st = H.State(cut(st.hazard), cut(st.mult))
    return E.score(E.loo_predict(mx, st, P, WEEKS), S.app_facts(mx, P), P)


@query("loo_scores", "V3", f"{LOO} SELECT app_id, weeks, horizon, round(s, 6) AS s, round(abs_err, 6) AS abs_err FROM scl")
def loo_scores(spark, d):
    return loo_scored(spark, d).select("app_id", "weeks", "horizon", r6("s").alias("s"), r6("abs_err").alias("abs_err"))


@query("loo_degradation", "V4", f"""{LOO} SELECT horizon, round(median(a.abs_err), 6) AS first, round(median(b.abs_err), 6) AS second, round(median(b.abs_err - a.abs_err), 6) AS paired_delta, count(*) AS n,
 round(median(b.abs_err) - median(a.abs_err), 6) AS degradation FROM (SELECT * FROM sc WHERE model = 'map') a JOIN scl b USING (app_id, weeks, horizon) GROUP BY 1""")
def loo_degradation(spark, d):
    s = scored(spark, d)[2]
    out = E.paired_delta(s.where("model = 'map'"), loo_scored(spark, d))
    return out.withColumns({c: r6(c) for c in ("first", "second", "paired_delta", "degradation")})


FED, OFF = (1, 2, 3, 4), (1, 2, 4)


def web_folds(spark, d, levers=None):
    name = "all" if levers is None or tuple(levers) == PW.levers else "_".join(levers) or "none"
    return staged(spark, d, f"cohort_folds_{name}", lambda: E.cohort_folds(
        web(spark, d), with_levers(levers), ref_hazard(spark, d), FED, OFF, min_subs=50, min_mature=30, levers=levers))


def with_levers(levers):
    return replace(PW, levers=tuple(levers)) if levers else PW


FOLD_COLS = ("actual", "v2", "v3", "ltv_anchor", "ltv_actual", "ltv_v2", "ltv_v3")


def _visible(src: str, on: str, name: str) -> str:
    return f"""{name} AS (SELECT fo.fold, ww.w AS weeks, l.* EXCLUDE (weeks_obs), ww.w::DOUBLE AS weeks_obs FROM {src} l JOIN fo ON {on}
  JOIN (SELECT unnest({list(FED)})::BIGINT AS w) ww ON l.weeks_obs >= ww.w AND l.step_k <= ww.w)"""


def _fold_curve(vis: str, tag: str, levers) -> str:
    """Members up to cv{tag}: curves of the visible rows under each fold's state."""
    lev = ", ".join(with_levers(levers).levers)
    return f"""{Q.first_levers(vis, with_levers(levers), 'fold, weeks', 'f' + tag)}, {Q.personal('f' + tag, 'muf', PW, 'p' + tag, 'fold', levers)}, {Q.ratio(vis, 'p' + tag, 'hbf', PW, 'fold, weeks', 'h' + tag, hby='fold')},
 m{tag} AS (SELECT fold, weeks, {lev}, count(*) AS w, any_value(mult) AS mult, any_value(coalesce(hr, 1)) AS hr FROM p{tag} LEFT JOIN h{tag} USING (fold, weeks) GROUP BY ALL), {Q.curve('m' + tag, 'hbf', PW, 'fold, weeks', 'cv' + tag, PW.h_ext, 'fold')}"""


def _pay(v: str) -> str:
    return f"(share_base * {PW.net_base_price} * {v} + CASE WHEN k >= 2 AND (k - 2) % 4 = 0 THEN share_ups * {PW.net_ups_price} * {v} ELSE 0 END)"


def folds_sql(levers=PW.levers) -> str:
    """Members up to fd: one row per fold, visible weeks and horizon."""
    chain = f"{Q.multipliers('lvf', 'hbf', PW, 'muf', levers=levers, by='fold, ')}, " if levers else ""
    return f"""{WMX}, {DONOR}, fo AS (SELECT app_id AS fold FROM wmx GROUP BY 1 HAVING count(DISTINCT sub_id) >= 50), trf AS (SELECT fold, t.* FROM tr_rows t JOIN fo ON app_id <> fold), {Q.hbase('trf', PW, 'owf', 'fold, ')},
 kmf AS (SELECT fold, max(step_k) AS km FROM owf WHERE votes >= {PW.min_cohorts} AND step_k <= {PW.hmax} GROUP BY 1), smf AS (SELECT kmf.fold, km, o.h AS oh, d.h AS dh FROM kmf JOIN owf o ON o.fold = kmf.fold AND o.step_k = km LEFT JOIN dn d ON d.step_k = km),
 srf AS (SELECT smf.fold, k AS step_k, CASE WHEN k <= km THEN o.h ELSE d.h * CASE WHEN dh > 0 THEN oh / dh ELSE 1 END END AS h FROM smf JOIN (SELECT unnest(range(1, {PW.h_ext + 1}))::BIGINT AS k) g ON true LEFT JOIN owf o ON o.fold = smf.fold AND o.step_k = k LEFT JOIN dn d ON d.step_k = k),
 hbf AS (SELECT fold, step_k, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY fold ORDER BY step_k), first_value(h IGNORE NULLS) OVER (PARTITION BY fold ORDER BY step_k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS h FROM srf),
 {Q.levered('trf', with_levers(levers), 'lvf')}, {chain}{Q.levered('wmx', with_levers(levers), 'lva')}, {Q.levered('tr_rows', with_levers(levers), 'lvt')},
 {_visible('lva', 'l.app_id = fo.fold', 'vo')}, {_visible('lvt', 'l.app_id <> fo.fold', 'vp')}, {_fold_curve('vo', '3', levers)}, {_fold_curve('vp', '2', levers)}, {Q.survival('wmx', PW, 'app_id', 'act', PW.return_periods)}, {CHECK},
 pe AS (SELECT DISTINCT p.*, m.app_id AS fold FROM pop p JOIN wmx m ON m.sub_id = p.session_id),
 af AS (SELECT fold, (coalesce(sum(paid_ups), 0) + {PW.attach_shrink} * (SELECT avg(paid_ups) FROM ob)) / (count(paid_ups) + {PW.attach_shrink}) AS share_ups FROM pe LEFT JOIN ob USING (session_id) GROUP BY 1),
 sf AS (SELECT fold, avg(has_base::INT) AS share_base FROM pe GROUP BY 1),
 pw_ AS (SELECT pe.session_id, {week()} AS week, sum(coalesce(amt_net, 0) * {HC!r}) AS net FROM (SELECT session_id, ts, amt_net FROM mo) JOIN pe USING (session_id) GROUP BY 1, 2),
 pp AS (SELECT fold, a AS weeks, a + o AS k, pe.session_id FROM pe JOIN (SELECT unnest({list(FED)})::BIGINT AS a) x ON true JOIN (SELECT unnest({list(OFF)})::BIGINT AS o) y ON age_weeks_now >= a + o + {PW.return_periods}),
 pv_ AS (SELECT fold, weeks, k, pp.session_id, coalesce(sum(net) FILTER (week <= weeks), 0) AS a, coalesce(sum(net) FILTER (week <= k), 0) AS t FROM pp LEFT JOIN pw_ USING (session_id) GROUP BY 1, 2, 3, 4),
 pr_ AS (SELECT fold, weeks, k, avg(a) AS anchor, avg(t) AS target FROM pv_ WHERE k <= (SELECT max(age_weeks_now) FROM pop) GROUP BY 1, 2, 3 HAVING count(*) >= 30 AND avg(t) > 0),
 ic AS (SELECT x.fold, x.weeks, x.k, sum({_pay('y.s')}) OVER w AS i2, sum({_pay('x.s')}) OVER w AS i3 FROM (SELECT fold, weeks, k, s FROM cv3) x JOIN (SELECT fold, weeks, k AS k2, s FROM cv2) y ON y.fold = x.fold AND y.weeks = x.weeks AND y.k2 = x.k JOIN af ON af.fold = x.fold JOIN sf ON sf.fold = x.fold WHERE x.k > x.weeks WINDOW w AS (PARTITION BY x.fold, x.weeks ORDER BY x.k)),
 big AS (SELECT fold, weeks FROM f3 GROUP BY 1, 2 HAVING count(*) >= 25),
 fd AS (SELECT big.fold AS cohort, big.weeks, o AS horizon_offset, act.k, act.mature AS n_mature, act.fact AS actual, b.s AS v2, c.s AS v3, anchor AS ltv_anchor, target AS ltv_actual, anchor + i2 AS ltv_v2, anchor + i3 AS ltv_v3
  FROM big JOIN (SELECT unnest({list(OFF)})::BIGINT AS o) x ON true JOIN act ON act.app_id = big.fold AND act.k = big.weeks + o LEFT JOIN cv3 c ON c.fold = big.fold AND c.weeks = big.weeks AND c.k = act.k LEFT JOIN cv2 b ON b.fold = big.fold AND b.weeks = big.weeks AND b.k = act.k
  LEFT JOIN pr_ ON pr_.fold = big.fold AND pr_.weeks = big.weeks AND pr_.k = act.k LEFT JOIN ic ON ic.fold = big.fold AND ic.weeks = big.weeks AND ic.k = act.k WHERE act.mature >= 30 AND act.fact > 0)"""


FOLDS = folds_sql()


@query("cohort_folds", "V5 V6", f"""{FOLDS} SELECT cohort, weeks, horizon_offset, k, n_mature, {', '.join(f'round({c}, 6) AS {c}' for c in FOLD_COLS)} FROM fd""")
def cohort_folds(spark, d):
    f = web_folds(spark, d)
    return f.select(F.col("fold").alias("cohort"), "weeks", "horizon_offset", "k", "n_mature", *[r6(c).alias(c) for c in FOLD_COLS])


ERRS = {"err_v2": "(v2 - actual) / actual", "err_v3": "(v3 - actual) / actual", "ltv_err_v2": "(ltv_v2 - ltv_actual) / ltv_actual", "ltv_err_v3": "(ltv_v3 - ltv_actual) / ltv_actual"}


@query("form_comparison", "V19", f"""{FOLDS} SELECT horizon_offset, weeks, count(*) AS n, {', '.join(f'round(median(abs({x})), 6) AS {c}_abs, round(median({x}), 6) AS {c}_sign' for c, x in ERRS.items())} FROM fd GROUP BY 1, 2""")
def form_comparison(spark, d):
    f = web_folds(spark, d)
    by = E.fold_summary(f, ["horizon_offset", "weeks"])
    return by.select("horizon_offset", "weeks", "n", *[r6(c).alias(c) for c in by.columns if c.endswith(("_abs", "_sign"))])


STUDY = (("none", ()), ("geo_billday", ("geo", "billday_bin")), ("utm_geo_billday", PW.levers),
         ("funnel_utm_geo_billday", ("funnel", *PW.levers)), ("utm_funnel_geo_billday", ("utm_source", "funnel", "geo", "billday_bin")))


@query("lever_study", "V12", " UNION ALL ".join(f"""SELECT * FROM ({folds_sql(levers)} SELECT '{name}' AS levers, horizon_offset, count(*) AS n, {', '.join(f'round(median(abs({x})), 6) AS {c}_abs, round(median({x}), 6) AS {c}_sign' for c, x in ERRS.items())} FROM fd GROUP BY 2)""" for name, levers in STUDY))
def lever_study(spark, d):
    parts = []
    for name, levers in STUDY:
        parts.append(E.fold_summary(web_folds(spark, d, levers), ["horizon_offset"]).withColumn("levers", F.lit(name)))
    out = reduce(DataFrame.unionByName, parts)
    return out.select("levers", "horizon_offset", "n", *[r6(c).alias(c) for c in out.columns if c.endswith(("_abs", "_sign"))])


@query("ltv_pairs", "V6", f"""{WMX}, co AS (SELECT app_id AS fold FROM wmx GROUP BY 1), pe AS (SELECT DISTINCT p.*, m.app_id AS fold FROM pop p JOIN wmx m ON m.sub_id = p.session_id),
 pw_ AS (SELECT pe.session_id, {week()} AS week, sum(coalesce(amt_net, 0) * {HC!r}) AS net FROM (SELECT session_id, ts, amt_net FROM mo) JOIN pe USING (session_id) GROUP BY 1, 2),
 pp AS (SELECT fold, a AS weeks, a + o AS k, pe.session_id FROM pe JOIN (SELECT unnest({list(FED)})::BIGINT AS a) x ON true JOIN (SELECT unnest({list(OFF)})::BIGINT AS o) y ON age_weeks_now >= a + o + {PW.return_periods}),
 pv_ AS (SELECT fold, weeks, k, pp.session_id, coalesce(sum(net) FILTER (week <= weeks), 0) AS a, coalesce(sum(net) FILTER (week <= k), 0) AS t FROM pp LEFT JOIN pw_ USING (session_id) GROUP BY 1, 2, 3, 4)
 SELECT fold, weeks, k, round(avg(a), 6) AS ltv_anchor, round(avg(t), 6) AS ltv_actual FROM pv_ WHERE k <= (SELECT max(age_weeks_now) FROM pop) GROUP BY 1, 2, 3 HAVING count(*) >= 30 AND avg(t) > 0""")
def ltv_pairs(spark, d):
    w = web(spark, d)
    people = w.pop.join(w.mx.select(F.col("sub_id").alias("session_id"), "app_id").distinct(), "session_id").withColumnRenamed("app_id", "fold")
    return E.ltv_pairs(w, people, PW, FED, OFF, 30).withColumns({"ltv_anchor": r6("ltv_anchor"), "ltv_actual": r6("ltv_actual")})


CUTS = ("1996-06-01", "1997-01-01")
PC = replace(P, min_payers=20, min_mature=30, min_risk=20, crash_floor=0.2)


def quarter_mx(spark, d):
    """The orders matrix with the customer's entry quarter as the application."""
    mx = orders_mx(spark, d)
    q = mx.groupBy("sub_id").agg(F.date_format(F.date_trunc("quarter", F.min("pay_ts")), "yyyy-MM").alias("app_id"))
    return staged(spark, d, "quarter_matrix", lambda: mx.drop("app_id").join(q, "sub_id"))


QMX = f"""{OMX}, qa AS (SELECT sub_id, strftime(date_trunc('quarter', min(pay_ts)), '%Y-%m') AS app_id FROM mx GROUP BY 1), qm AS (SELECT mx.* EXCLUDE (app_id), qa.app_id FROM mx JOIN qa USING (sub_id)),
 {Q.survival('qm', PC, name='qs')}, qc AS (SELECT app_id, worst FROM (SELECT app_id, least(1.0, coalesce(min(r) FILTER (at_risk >= {PC.crash_min_risk}), 1.0)) AS worst FROM (
   SELECT app_id, k, count(*) AS at_risk, avg(CASE WHEN ms >= k THEN 1.0::DOUBLE ELSE 0 END) AS r FROM qs_p JOIN (SELECT unnest(range(2, {PC.hmax + 1}))::BIGINT AS k) g ON wo >= k AND ms >= k - 1 GROUP BY ALL) GROUP BY 1)),
 cu AS (SELECT unnest([{', '.join(f"TIMESTAMP '{c}'" for c in CUTS)}]) AS t),
 fp AS (SELECT app_id, min(pay_ts) AS f FROM qm GROUP BY 1),
 iv AS (SELECT t, fp.app_id, f, {Q.days('f', 't')} / {PC.period_days} BETWEEN 1 AND 8 AS young, coalesce(mature, 0) >= {PC.min_mature} AS wf, coalesce(worst < {PC.crash_floor}, false) AS crash
  FROM fp JOIN cu ON true LEFT JOIN (SELECT * FROM qs WHERE k = {PC.horizons[0]}) s ON s.app_id = fp.app_id LEFT JOIN qc ON qc.app_id = fp.app_id)"""


@query("calendar_inventory", "V7", f"""{QMX} SELECT epoch_us(t) AS t_us, count(*) FILTER (young) AS young_candidates, count(*) FILTER (young AND wf) AS with_fact, count(*) FILTER (young AND wf AND NOT crash) AS evaluable,
 (SELECT count(*) FROM qm WHERE pay_ts < t) AS train_rows FROM iv GROUP BY t""")
def calendar_inventory(spark, d):
    mx = quarter_mx(spark, d)
    c = E.inventory_counts(E.calendar_inventory(mx, CUTS, PC), mx, CUTS)
    return c.select(F.unix_micros("t").alias("t_us"), "young_candidates", "with_fact", "evaluable", "train_rows")


CAL = f"""{QMX}, sn0 AS (SELECT t, qm.* EXCLUDE (weeks_obs), min(pay_ts) OVER (PARTITION BY t, sub_id) AS f0 FROM qm JOIN cu ON pay_ts < t),
 sn AS (SELECT *, {Q.days('f0', 't')} / {PC.period_days} AS weeks_obs FROM sn0), {Q.hbase('sn', PC, 'hbt', 't, ')}, {Q.levered('sn', PC, 'lvt')},
 cp AS (SELECT t, app_id, sub_id, max(step_k) AS ms, max(weeks_obs) AS wo FROM sn GROUP BY 1, 2, 3),
 ck AS (SELECT t, app_id, k, count(*) AS at_risk, avg(CASE WHEN ms >= k THEN 1.0::DOUBLE ELSE 0 END) AS r FROM cp JOIN (SELECT unnest(range(2, {PC.hmax + 1}))::BIGINT AS k) g ON wo >= k AND ms >= k - 1 GROUP BY ALL),
 cx AS (SELECT t, app_id FROM ck GROUP BY 1, 2 HAVING min(r) FILTER (at_risk >= {PC.crash_min_risk}) < {PC.crash_floor}),
 cn AS (SELECT t, app_id FROM cp GROUP BY 1, 2 HAVING count(*) >= {PC.min_payers}),
 lvc AS (SELECT l.* FROM lvt l LEFT JOIN (SELECT * FROM cx JOIN cn USING (t, app_id)) c ON c.t = l.t AND c.app_id = l.app_id WHERE c.t IS NULL),
 {Q.multipliers('lvc', 'hbt', PC, 'mut', by='t, ')},
 tg AS (SELECT l.*, least(CAST(floor({Q.whole('f', 'l.t')} / {PC.period_days}) AS BIGINT), 8) AS weeks FROM lvt l JOIN iv ON iv.t = l.t AND iv.app_id = l.app_id WHERE young AND wf AND NOT crash),
 {Q.first_levers('tg', PC, 't, app_id', 'flt')}, {Q.personal('flt', 'mut', PC, 'pmt', 't')}, tgo AS (SELECT * FROM tg WHERE step_k <= weeks), {Q.ratio('tgo', 'pmt', 'hbt', PC, 't, app_id', 'hrt', hby='t')},
 mit AS (SELECT t, app_id, geo, media_source, billday_bin, count(*) AS w, any_value(mult) AS mult, any_value(coalesce(hr, 1)) AS hr FROM pmt LEFT JOIN hrt USING (t, app_id) GROUP BY ALL),
 {Q.curve('mit', 'hbt', PC, 't, app_id', 'cvt', hby='t')},
 eg AS (SELECT t, app_id, step_k, count(*) AS na, count(*) FILTER (weeks_obs >= step_k) AS n, sum(died) FILTER (weeks_obs >= step_k)::DOUBLE AS dd FROM tgo GROUP BY ALL),
 eh AS (SELECT eg.t, app_id, exp(coalesce(sum(n * ln(least(greatest(dd / n / h, 0.2), 5.0))) FILTER (n >= 20 AND h > 0) / sum(n) FILTER (n >= 20 AND h > 0), 0) * sum(na) / (sum(na) + 800.0)) AS hr FROM eg LEFT JOIN hbt ON hbt.t = eg.t AND hbt.step_k = eg.step_k GROUP BY 1, 2),
 ev AS (SELECT eh.t, app_id, k, product(CASE WHEN h IS NULL THEN 1 ELSE 1 - least(greatest(h * hr, 0.001), 0.999) END) OVER (PARTITION BY eh.t, app_id ORDER BY k) AS s FROM eh JOIN (SELECT unnest(range(1, {PC.hmax + 1}))::BIGINT AS k) g ON true LEFT JOIN hbt ON hbt.t = eh.t AND step_k = k),
 ca AS (SELECT model, t, app_id, k AS horizon, s, fact, (s - fact) / fact AS signed_err FROM (SELECT 'map' AS model, t, app_id, k, s FROM cvt UNION ALL SELECT 'empirical', t, app_id, k, s FROM ev) JOIN qs USING (app_id, k) WHERE fact > 0 AND k IN {PC.horizons})"""


def calendar_scores(spark, d):
    return staged(spark, d, "calendar_scores", lambda: E.calendar_backtest(quarter_mx(spark, d), CUTS, PC))


@query("calendar_backtest", "V7 M13", f"{CAL} SELECT model, epoch_us(t) AS t_us, app_id, horizon, round(s, 6) AS s, round(fact, 6) AS fact, round(signed_err, 6) AS signed_err FROM ca")
def calendar_backtest(spark, d):
    c = calendar_scores(spark, d)
    return c.select("model", F.unix_micros("t").alias("t_us"), "app_id", "horizon", *[r6(x).alias(x) for x in ("s", "fact", "signed_err")])


@query("step_vs_calendar", "V8 V7", f"""SELECT model, horizon, round(step_err, 6) AS step_err, round(calendar_err, 6) AS calendar_err, step_n, calendar_n, round(calendar_err - step_err, 6) AS gap
 FROM (SELECT * FROM ({PRED} SELECT model, horizon, median(abs_err) AS step_err, count(*) AS step_n FROM sc GROUP BY 1, 2))
 FULL JOIN (SELECT * FROM ({CAL} SELECT model, horizon, median(abs(signed_err)) AS calendar_err, count(*) AS calendar_n FROM ca GROUP BY 1, 2)) USING (model, horizon)""")
def step_vs_calendar(spark, d):
    """The same models on rows seen by step and on rows seen by date."""
    j = E.step_against_calendar(scored(spark, d)[2], calendar_scores(spark, d))
    return j.select("model", "horizon", *[r6(c).alias(c) for c in ("step_err", "calendar_err", "gap")], "step_n", "calendar_n")


SEG = f"""{MIX}{EMPM}, {Q.survival('mx', P, 'app_id', 'dsa')}, ga AS (SELECT raw, cat, mult AS mg FROM mu WHERE lever = 'geo'),
 pg AS (SELECT pm.*, coalesce(cat, geo) AS segment, coalesce(mg, 1) AS m_geo, hr FROM pm JOIN cr USING (app_id) LEFT JOIN ga ON raw = geo JOIN (SELECT app_id, hr FROM hr WHERE weeks = 4) h USING (app_id) WHERE NOT crash),
 mg AS (SELECT app_id, segment, geo, media_source, billday_bin, count(*) AS w, any_value(mult) AS mult, any_value(hr) AS hr FROM pg GROUP BY ALL),
 {Q.curve('mg', 'hb', P, 'app_id, segment', 'cvs')}, {Q.curve('mg', 'hb', P, 'app_id', 'cva')},
 mxs AS (SELECT mx.*, segment, m_geo FROM mx JOIN pg USING (sub_id)), {Q.survival('(SELECT sub_id, step_k, weeks_obs, segment, pg.app_id FROM mx JOIN pg USING (sub_id))', P, 'app_id, segment', 'dss')},
 sg AS (SELECT c.app_id, c.segment, c.k, c.s AS map, a.s AS app_map, e.s AS emp, f.fact, f.mature, x.fact AS app_fact, n_subs, m_geo FROM cvs c JOIN cva a USING (app_id, k) JOIN (SELECT * FROM ec WHERE weeks = 4) e USING (app_id, k)
  JOIN (SELECT app_id, segment, count(*) AS n_subs, any_value(m_geo) AS m_geo FROM pg GROUP BY 1, 2) z USING (app_id, segment) LEFT JOIN dss f USING (app_id, segment, k) LEFT JOIN dsa x ON x.app_id = c.app_id AND x.k = c.k WHERE c.k IN {P.horizons})"""


def segment_rows(spark, d):
    mx, st = fitted(spark, d)
    return staged(spark, d, "segments", lambda: E.segments(mx, st, S.select_apps(mx, P), P, 4))


@query("segment_backtest", "V9", f"""{SEG} SELECT k AS horizon, count(*) AS n, round(median(abs(map - fact) / fact), 6) AS map_err, round(median(abs(emp - fact) / fact), 6) AS emp_err, count(*) FILTER (abs(map - fact) < abs(emp - fact)) AS wins,
  count(*) FILTER (sign(fact - app_fact) <> 0 AND sign(map - app_map) <> 0) AS tests, count(*) FILTER (sign(fact - app_fact) <> 0 AND sign(fact - app_fact) = sign(map - app_map)) AS hits,
  count(*) FILTER (sign(fact - app_fact) <> 0 AND sign(map - app_map) <> 0 AND abs(m_geo - 1) > 0.05) AS bets, count(*) FILTER (sign(fact - app_fact) <> 0 AND sign(fact - app_fact) = sign(map - app_map) AND abs(m_geo - 1) > 0.05) AS bet_hits FROM sg WHERE n_subs >= 15 AND mature >= 15 AND fact > 0 GROUP BY 1""")
def segment_backtest(spark, d):
    s = E.segment_scores(segment_rows(spark, d), 15, 15)
    return s.select("horizon", "n", r6("map_err").alias("map_err"), r6("emp_err").alias("emp_err"), "wins", "tests", "hits", "bets", "bet_hits")


@query("segment_direction", "V9", f"""{SEG} SELECT app_id, segment, k, round(map - app_map, 5) AS predicted_gap, round(fact - app_fact, 5) AS fact_gap, round(m_geo, 6) AS m_geo, n_subs FROM sg WHERE fact IS NOT NULL""")
def segment_direction(spark, d):
    s = segment_rows(spark, d).where("fact is not null")
    return s.select("app_id", "segment", "k", F.round(F.col("map") - F.col("app_map"), 5).alias("predicted_gap"),
                    F.round(F.col("fact") - F.col("app_fact"), 5).alias("fact_gap"), r6("m_geo").alias("m_geo"), "n_subs")


@query("segment_reconstruction", "V10", f"""{SEG}, rc AS (SELECT app_id, k, sum(map * n_subs) / sum(n_subs) AS r, any_value(app_map) AS a FROM sg GROUP BY 1, 2)
 SELECT k, round(max(abs(r - a)), 6) AS worst, max(abs(r - a)) <= 0.02 AS ok FROM rc GROUP BY 1""")
def segment_reconstruction(spark, d):
    return E.reconstruction(segment_rows(spark, d)).withColumn("worst", r6("worst"))


DRIFT = f"""{OMX}, qa AS (SELECT sub_id, strftime(date_trunc('quarter', min(pay_ts)), '%Y-%m') AS app_id FROM mx GROUP BY 1), qm AS (SELECT mx.* EXCLUDE (app_id), qa.app_id FROM mx JOIN qa USING (sub_id)), {Q.survival('qm', PC, name='qs')},
 pt AS (SELECT f.app_id, launch, {Q.days('launch', '(SELECT max(pay_ts) FROM qm)')} / {PC.period_days} AS age, {', '.join(f'max(fact) FILTER (k = {h} AND mature >= {PC.min_mature}) AS fact_{i}' for i, h in enumerate(PC.horizons))}
  FROM (SELECT app_id, min(pay_ts) AS launch FROM qm GROUP BY 1) f LEFT JOIN qs USING (app_id) GROUP BY 1, 2)"""


def drift_table(spark, d):
    mx = quarter_mx(spark, d)
    return E.portfolio_table(mx, PC, mx.agg(F.max("pay_ts")).scalar())


@query("launch_trend", "V11 A13", f"""{DRIFT}, tm AS (SELECT *, (epoch_us(launch) - min(epoch_us(launch)) OVER ()) / (86400e6::DOUBLE * 30.44) AS m FROM pt WHERE fact_1 IS NOT NULL)
 SELECT round(regr_slope(fact_1 * 100, m), 6) AS slope, round(regr_intercept(fact_1 * 100, m), 6) AS intercept, round(corr(m, fact_1 * 100), 6) AS r, count(*) AS n FROM tm""")
def launch_trend(spark, d):
    return E.launch_trend(drift_table(spark, d)).withColumns({c: r6(c) for c in ("slope", "intercept", "r")})


@query("matured_split", "V11", f"""{DRIFT} SELECT CASE WHEN fact_2 IS NOT NULL THEN 'matured' WHEN age >= {PC.horizons[2]} THEN 'old_not_matured' ELSE 'young' END AS grp, count(*) AS n, count(fact_1) AS with_fact, round(avg(fact_1), 6) AS mean_fact FROM pt GROUP BY 1""")
def matured_split(spark, d):
    return E.matured_split(drift_table(spark, d)).withColumn("mean_fact", r6("mean_fact"))


@query("multiplier_report", "V13", f"""{FIT}, mc AS (SELECT lever, cat, any_value(mult) AS mult, sum(n)::BIGINT AS n FROM mu GROUP BY 1, 2)
 SELECT lever, cat, round(mult, 6) AS mult, n, round(n / sum(n) OVER (PARTITION BY lever), 6) AS share, CASE WHEN mult > 1.05 THEN 'higher risk' WHEN mult < 0.95 THEN 'lower risk' ELSE 'neutral' END AS meaning FROM mc""")
def multiplier_report(spark, d):
    _, st = fitted(spark, d)
    return E.multiplier_report(st.mult).withColumns({"mult": r6("mult"), "share": r6("share")})


PROF = f"""{FITSQL}, cfa AS (SELECT *, cumr / payers AS payer_ltv, active_users / payers AS rp, last_value(revenue / nullif(active_users, 0) IGNORE NULLS) OVER (PARTITION BY cohort ORDER BY rebill_number) AS a FROM ad),
 pf AS (SELECT cohort, rebill_number, payer_ltv, rp, s, sum(CASE WHEN rebill_number = 0 THEN a ELSE coalesce(s * a, 0) END) OVER (PARTITION BY cohort ORDER BY rebill_number) AS model_ltv FROM cfa LEFT JOIN cs ON cs.k = rebill_number)"""


def profile(spark, d):
    return staged(spark, d, "error_profile", lambda: _profile(spark, d))


def _profile(spark, d):
    from tenurekit.operators import calibrate as C
    from tenurekit.plans.cohort_plans import fitted as corrected
    f = K.admitted(facts(spark, d))
    ref, corr = corrected(spark, d)
    s = C.survival_of(C.corrected_hazard(ref, corr)).agg(F.collect_list(F.struct("k", "s"))).scalar()
    per = f.select("cohort").distinct().withColumn("_s", s).select("cohort", F.explode("_s").alias("r")).select("cohort", "r.*")
    return E.error_profile(f, per)


@query("error_profile", "V14 V20", f"{PROF} SELECT cohort, rebill_number, round(payer_ltv, 4) AS payer_ltv, round(model_ltv, 8) AS model_ltv, round((model_ltv - payer_ltv) / payer_ltv * 100, 6) AS signed_err FROM pf")
def error_profile(spark, d):
    return profile(spark, d).select("cohort", "rebill_number", F.round("payer_ltv", 4).alias("payer_ltv"), F.round("model_ltv", 8).alias("model_ltv"), r6("signed_err").alias("signed_err"))


@query("error_stability", "V14", f"""{PROF}, pe AS (SELECT rebill_number, (model_ltv - payer_ltv) / payer_ltv * 100 AS e FROM pf)
 SELECT rebill_number, count(e) AS n, round(avg(e), 6) AS mean, round(stddev(e), 6) AS std, round(min(e), 6) AS min, round(max(e), 6) AS max FROM pe GROUP BY 1""")
def error_stability(spark, d):
    return E.error_stability(profile(spark, d)).withColumns({c: r6(c) for c in ("mean", "std", "min", "max")})


@query("residual_slope", "V15", f"""{PROF}, sb2 AS (SELECT rebill_number, avg((s - rp) / nullif(rp, 0) * 100) AS mean FROM pf GROUP BY 1)
 SELECT CASE WHEN rebill_number <= 8 THEN 'reliable' ELSE 'tail' END AS zone, round(avg(mean), 6) AS mean_residual, round(regr_slope(mean, rebill_number::DOUBLE), 6) AS slope, count(*) AS n FROM sb2 WHERE rebill_number >= 1 GROUP BY 1""")
def residual_slope(spark, d):
    st = E.error_stability(profile(spark, d), "surv_err")
    return E.residual_slope(st, 8).withColumns({"mean_residual": r6("mean_residual"), "slope": r6("slope")})


@query("correction_folds", "V15", f"""{FITSQL}, fz AS (SELECT DISTINCT cohort AS fold FROM ad), qh AS (SELECT fold, k, sum(prv) AS nr, sum(prv - cur) / sum(prv) AS h FROM ph0 JOIN fz ON fold <> cohort WHERE k >= 1 GROUP BY 1, 2),
 ql AS (SELECT fold, k, nr AS w, (k - 1)::DOUBLE AS x, ln(nullif(qh.h, 0) / ref.h) AS y FROM qh JOIN ref ON step_k = k WHERE nr >= 40), qk AS (SELECT fold, max(k) AS k_max FROM ql GROUP BY 1),
 q0 AS (SELECT fold, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM ql WHERE y IS NOT NULL GROUP BY 1),
 q1 AS (SELECT fold, k_max, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS beta, (sy - beta * sx) / sw AS alpha FROM q0 JOIN qk USING (fold)),
 q2 AS (SELECT fold, step_k, ref.h * CASE WHEN step_k <= k_max THEN exp(alpha + beta * (step_k - 1)) WHEN step_k <= k_max + 3 THEN exp(alpha + beta * (k_max - 1)) * (1 - (step_k - k_max) / 4.0::DOUBLE) + (step_k - k_max) / 4.0::DOUBLE ELSE 1 END AS h FROM q1 JOIN ref ON step_k <= {P.hmax}),
 q3 AS (SELECT fold AS cohort, step_k AS rebill_number, product(1 - least(greatest(h, 0.001), 0.999)) OVER (PARTITION BY fold ORDER BY step_k) AS s FROM q2),
 q4 AS (SELECT cohort, (s - active_users / payers) / (active_users / payers) * 100 AS e FROM ad JOIN q3 USING (cohort, rebill_number) WHERE rebill_number >= 1 AND active_users > 0)
 SELECT cohort, round(avg(e), 6) AS mean_signed, round(avg(abs(e)), 6) AS mean_abs, count(*) AS n FROM q4 GROUP BY 1""")
def correction_folds(spark, d):
    out = E.correction_folds(K.admitted(facts(spark, d)), ref_hazard(spark, d), P.hmax)
    return out.withColumns({"mean_signed": r6("mean_signed"), "mean_abs": r6("mean_abs")})


@query("composition_vs_error", "V16 A16 A13", f"""{PROF}, fe AS (SELECT cohort, arg_max((model_ltv - payer_ltv) / payer_ltv * 100, rebill_number) AS err FROM pf GROUP BY 1),
 me AS (SELECT sub_id, CAST(date_trunc('quarter', start_ts) AS DATE) AS cohort, prov FROM ss JOIN (SELECT sub_id, arg_min(payment_provider, (ts, tie)) AS prov FROM go GROUP BY 1) USING (sub_id)),
 sh AS (SELECT cohort, avg(CASE WHEN prov = 'provider_a' THEN 1.0::DOUBLE ELSE 0 END) AS a_share, count(*) AS n FROM me GROUP BY 1)
 SELECT round(corr(err, a_share), 6) AS r, count(*) AS cohorts FROM fe JOIN sh USING (cohort)""")
def composition_vs_error(spark, d):
    p = profile(spark, d).groupBy("cohort").agg(F.max_by("signed_err", "rebill_number").alias("err"))
    e = golden(spark, d)
    prov = e.groupBy("sub_id").agg(F.min_by("payment_provider", F.struct("ts", "tie")).alias("prov"))
    m = members(spark, d, e).join(prov, "sub_id")
    s = E.value_share(m, "cohort", F.col("prov") == "provider_a", "a_share")
    return p.join(s, "cohort").agg(r6(F.corr("err", "a_share")).alias("r"), F.count(F.lit(1)).alias("cohorts"))


@query("top_share", "A16", f"""{OMX}, c1 AS (SELECT app_id, geo, count(*) AS n FROM mx GROUP BY 1, 2) SELECT app_id, arg_min(geo, (-n, geo)) AS top_geo, round(max(n) / sum(n), 6) AS top_geo_share FROM c1 GROUP BY 1""")
def top_share(spark, d):
    return E.top_share(orders_mx(spark, d), "app_id", "geo").withColumn("top_geo_share", r6("top_geo_share"))


@query("ratio_sensitivity", "V17", f"""{MIX}{COMBO}, {Q.curve('mix', 'hb', P, 'app_id, weeks')}, {Q.survival('mx', P)}, pmm AS (SELECT app_id, avg(mult) AS personal_mult FROM pm GROUP BY 1)
 SELECT app_id, round(fact, 6) AS fact, round(max(s) FILTER (weeks = 1), 6) AS s_1, round(max(s) FILTER (weeks = 2), 6) AS s_2, round(max(hr) FILTER (weeks = 1), 6) AS hr_1, round(max(hr) FILTER (weeks = 2), 6) AS hr_2, round(any_value(personal_mult), 6) AS personal_mult,
  round((SELECT max(o / e) FROM hr_s x WHERE x.app_id = cv.app_id AND x.step_k = 2 AND x.weeks = 2), 6) AS ratio_step2
 FROM cv JOIN hr USING (app_id, weeks) JOIN ds USING (app_id, k) JOIN cr USING (app_id) JOIN pmm USING (app_id) WHERE k = 8 AND weeks <= 2 AND NOT crash AND mature >= {P.min_mature} AND fact > 0 GROUP BY app_id, fact""")
def ratio_sensitivity(spark, d):
    mx, st = fitted(spark, d)
    r = E.ratio_sensitivity(mx, st, P, 8, S.app_facts(mx, P))
    return r.select("app_id", *[r6(c).alias(c) for c in ("fact", "s_1", "s_2", "hr_1", "hr_2", "personal_mult", "ratio_step2")])


FRO = f"""{FIT}, yq AS (SELECT sub_id, strftime(date_trunc('quarter', min(pay_ts)), '%Y-%m') AS entry, min(pay_ts) AS f FROM mx GROUP BY 1), yu AS (SELECT lv.*, entry, f FROM lv JOIN yq USING (sub_id)),
 cu AS (SELECT unnest([{', '.join(f"TIMESTAMP '{c}'" for c in CUTS)}]) AS t),
 yv AS (SELECT yu.* EXCLUDE (weeks_obs), t, {Q.days('f', 't')} / {P.period_days} AS weeks_obs FROM yu JOIN cu ON pay_ts < t),
 yw AS (SELECT entry, t, greatest(1, least(8, CAST(floor({Q.whole('min(pay_ts)', 't')} / {P.period_days}) AS BIGINT))) AS weeks FROM yv GROUP BY 1, 2),
 {Q.first_levers('yv', P, 'entry, t', 'yl')}, {Q.personal('yl', 'mu', P, 'yp')}, yo AS (SELECT yv.* FROM yv JOIN yw USING (entry, t) WHERE step_k <= weeks), {Q.ratio('yo', 'yp', 'hb', P, 'entry, t', 'yh')},
 ym AS (SELECT entry, t, geo, media_source, billday_bin, count(*) AS w, any_value(mult) AS mult, any_value(coalesce(hr, 1)) AS hr FROM yp LEFT JOIN yh USING (entry, t) GROUP BY ALL),
 {Q.curve('ym', 'hb', P, 'entry, t', 'yc')}, {Q.survival('yu', P, 'entry', 'ys')}"""


@query("frozen_backtest", "V18", f"""{FRO} SELECT yc.entry, epoch_us(t) AS t_us, yc.k AS horizon, round(fact, 6) AS fact, round(s, 6) AS predicted, coalesce(mature, 0) AS n_mature, round(CASE WHEN fact > 0 THEN (s - fact) / fact * 100 END, 6) AS signed_err
  FROM yc LEFT JOIN ys ON ys.entry = yc.entry AND ys.k = yc.k WHERE yc.k IN {P.horizons}""")
def frozen_backtest(spark, d):
    """Every entry quarter at every cut-off, by the state fitted on the whole portfolio."""
    mx, st = fitted(spark, d)
    f = E.frozen_backtest(quarter_mx(spark, d).withColumnRenamed("app_id", "entry"), st, CUTS, P, ["entry"])
    return f.select("entry", F.unix_micros("t").alias("t_us"), "horizon", "n_mature", *[r6(c).alias(c) for c in ("fact", "predicted", "signed_err")])
