"""Hazard models on the step matrix of the driver's orders."""

from dataclasses import replace

from pyspark.sql import functions as F

from tenurekit.functions.exprs import r6
from tenurekit.operators import hazard as H
from tenurekit.operators import survival as S
from tenurekit.params import ORDERS
from tenurekit.plans import sql as Q
from tenurekit.plans.ladder_plans import OMX, orders_mx
from tenurekit.plans.registry import query
from tenurekit.plans.stages import staged

P = ORDERS
WEEKS = P.seen_weeks
HB = f"{OMX}, {Q.hbase('mx', P)}"
FIT = f"{HB}, {Q.levered('mx', P)}, {Q.crash('mx', P)}, crx AS (SELECT app_id FROM cr WHERE crash), {Q.multipliers('lv', 'hb', P, crash='crx')}"
MIX = f"{FIT}, {Q.first_levers('lv', P, 'app_id')}, {Q.personal('fl1', 'mu', P, 'pm')}, {Q.ratio('lv', 'pm', 'hb', P, 'app_id', weeks=WEEKS)}"
COMBO = """, mix AS (SELECT app_id, weeks, geo, media_source, billday_bin, count(*) AS w, any_value(mult) AS mult, any_value(hr) AS hr
 FROM pm JOIN hr USING (app_id) GROUP BY ALL)"""


def fitted(spark, d):
    mx = orders_mx(spark, d)
    h = staged(spark, d, "orders_hazard", lambda: H.portfolio_hazard(mx, P))
    mult = staged(spark, d, "orders_multipliers", lambda: H.residual_multipliers(
        H.clean_cells(mx, P, S.select_apps(mx, P).where("crash")), h, P))
    return mx, H.State(h, mult)


@query("portfolio_hazard", "H1 A4", f"{HB} SELECT step_k, round(h, 6) AS h FROM hb")
def portfolio_hazard(spark, d):
    return H.portfolio_hazard(orders_mx(spark, d), P).select("step_k", r6("h").alias("h"))


@query("hazard_support", "H2", f"{HB} SELECT step_k, votes FROM hb")
def hazard_support(spark, d):
    return H.portfolio_hazard(orders_mx(spark, d), P).select("step_k", "votes")


@query("mean_hazard", "H4", f"{OMX} SELECT step_k, round(avg(died), 6) AS h, count(*) AS n FROM mx GROUP BY 1")
def mean_hazard(spark, d):
    return H.mean_hazard(orders_mx(spark, d)).withColumn("h", r6("h"))


@query("clean_zone", "H5 J8", f"""{OMX}, {Q.levered('mx', P)}, {Q.crash('mx', P)} SELECT geo, media_source, billday_bin, step_k, count(*) AS n, sum(died)::BIGINT AS died
 FROM lv WHERE step_k <= 8 AND weeks_obs >= step_k AND app_id NOT IN (SELECT app_id FROM cr WHERE crash) GROUP BY ALL""")
def clean_zone(spark, d):
    mx = orders_mx(spark, d)
    return H.clean_cells(mx, P, S.select_apps(mx, P).where("crash")).select("geo", "media_source", "billday_bin", "step_k", "n", "died")


@query("residual_multipliers", "H6 F13 J13", f"{FIT} SELECT lever, raw, cat, round(mult, 6) AS mult, n FROM mu")
def residual_multipliers(spark, d):
    mx, st = fitted(spark, d)
    return st.mult.select("lever", "raw", "cat", r6("mult").alias("mult"), "n")


@query("multiplier_sanity", "H7 A6", f"""{FIT}, mc AS (SELECT lever, cat, any_value(mult) AS mult, sum(n) AS n FROM mu GROUP BY 1, 2)
 SELECT lever, round(sum(mult * n) / sum(n), 6) AS weighted_mean, count(*) AS categories, sum(n)::BIGINT AS rows,
  any_value(c) AS collapsed, round(sum(mult * n) / sum(n), 6) BETWEEN 0.9 AND 1.1 AS ok
 FROM mc JOIN (SELECT lever, count(*) FILTER (cat = 'other' AND raw <> 'other') AS c FROM mu GROUP BY 1) USING (lever) GROUP BY 1""")
def multiplier_sanity(spark, d):
    _, st = fitted(spark, d)
    return H.multiplier_sanity(st.mult, P).withColumn("weighted_mean", r6("weighted_mean"))


@query("lever_combos", "H8", f"""{FIT}, {Q.first_levers('lv', P, 'app_id')}, {Q.personal('fl1', 'mu', P, 'pm')}
 SELECT app_id, geo, media_source, billday_bin, count(*) AS w, round(any_value(mult), 6) AS mult FROM pm GROUP BY ALL""")
def lever_combos(spark, d):
    mx, st = fitted(spark, d)
    c = H.personal_multiplier(H.combos(mx, P, ["app_id"]), st.mult, P)
    return c.select("app_id", *P.levers, "w", r6("mult").alias("mult"))


@query("hazard_ratio", "H9 X14", f"{MIX} SELECT app_id, weeks, n_seen::BIGINT AS n_seen, round(hr, 6) AS hr FROM hr")
def hazard_ratio(spark, d):
    mx, st = fitted(spark, d)
    hr = H.hazard_ratio(H.ratio_cells(mx, P, ["app_id"]), st, P, ["app_id"], WEEKS)
    return hr.select("app_id", "weeks", "n_seen", r6("hr").alias("hr"))


@query("map_predict", "H10 H11 W6", f"{MIX}{COMBO}, {Q.curve('mix', 'hb', P, 'app_id, weeks')} SELECT app_id, weeks, k, round(s, 6) AS s FROM cv")
def map_predict(spark, d):
    mx, st = fitted(spark, d)
    return H.predict(mx, st, P, ["app_id"], WEEKS).withColumn("s", r6("s"))


EMP = f"""{HB}, er AS (SELECT app_id, weeks, sum(na) AS n_seen, exp(coalesce(sum(n * ln(least(greatest(dd / n / h, 0.2), 5.0))) FILTER (n >= 20 AND h > 0)
   / sum(n) FILTER (n >= 20 AND h > 0), 0) * sum(na) / (sum(na) + 800.0)) AS hr
  FROM (SELECT app_id, step_k, count(*) AS na, count(*) FILTER (weeks_obs >= step_k) AS n, sum(died) FILTER (weeks_obs >= step_k)::DOUBLE AS dd FROM mx GROUP BY 1, 2) g
  JOIN (SELECT unnest({list(WEEKS)})::BIGINT AS weeks) w ON step_k <= weeks LEFT JOIN hb USING (step_k) GROUP BY 1, 2),
 ec AS (SELECT app_id, weeks, k, product(CASE WHEN h IS NULL THEN 1 ELSE 1 - least(greatest(h * hr, 0.001), 0.999) END) OVER (PARTITION BY app_id, weeks ORDER BY k) AS s
  FROM er JOIN (SELECT unnest(range(1, {P.hmax + 1}))::BIGINT AS k) g ON true LEFT JOIN hb ON hb.step_k = k)"""


@query("empirical_predict", "H12", f"{EMP} SELECT app_id, weeks, k, round(s, 6) AS s FROM ec")
def empirical_predict(spark, d):
    return H.empirical_predict(orders_mx(spark, d), P, ["app_id"], WEEKS).withColumn("s", r6("s"))


PS = replace(P, min_risk=5)  # segments are small
_SEAM = ", ".join(f"max(CASE WHEN k = km THEN {c} END) OVER (PARTITION BY geo) AS s_{c}" for c in ("oh", "rh", "dh"))
SPL = f"""{OMX}, rg AS (SELECT n_name AS geo, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey), ownr AS (SELECT mx.*, region FROM mx JOIN rg USING (geo)),
 {Q.hbase('ownr', PS, 'ow', 'geo, ')}, {Q.hbase('ownr', PS, 'rh', 'region, ')}, {Q.hbase('mx', P, 'dn')},
 gr AS (SELECT g.*, o.h AS oh, o.votes, r.h AS rh, d.h AS dh FROM (SELECT DISTINCT geo, region, unnest(range(1, {P.h_ext + 1}))::BIGINT AS k FROM ownr) g
  LEFT JOIN ow o ON o.geo = g.geo AND o.step_k = k LEFT JOIN rh r ON r.region = g.region AND r.step_k = k LEFT JOIN dn d ON d.step_k = k),
 gk AS (SELECT *, coalesce(max(CASE WHEN votes >= {P.min_cohorts} AND k <= {P.hmax} THEN k END) OVER (PARTITION BY geo), 0) AS km FROM gr),
 gs AS (SELECT *, {_SEAM} FROM gk),
 raw AS (SELECT geo, k AS step_k, km, CASE WHEN k <= km THEN oh ELSE coalesce(rh * CASE WHEN s_rh > 0 AND s_oh IS NOT NULL THEN s_oh / s_rh ELSE 1 END, dh * CASE WHEN s_dh > 0 AND s_oh IS NOT NULL THEN s_oh / s_dh ELSE 1 END) END AS h FROM gs),
 sp AS (SELECT geo, step_k, km AS k_max, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY geo ORDER BY step_k),
   first_value(h IGNORE NULLS) OVER (PARTITION BY geo ORDER BY step_k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS h FROM raw)"""


@query("spliced_hazard", "H3 W8", f"{SPL} SELECT geo, step_k, k_max, round(h, 6) AS h FROM sp")
def spliced_hazard(spark, d):
    """Every nation on its own data, then on its region's, then on the portfolio's."""
    mx = orders_mx(spark, d)
    places = spark.read.parquet(f"{d}/nation.parquet").join(spark.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    seg = mx.join(places.select(F.col("n_name").alias("geo"), F.col("r_name").alias("region")), "geo")
    donors = [(H.portfolio_hazard(seg, PS, ["region"]), ["region"]), (H.portfolio_hazard(mx, P), [])]
    out = H.splice_hazard(H.portfolio_hazard(seg, PS, ["geo"]), P, by=["geo"], donors=donors, groups=seg.select("geo", "region"))
    return out.select("geo", "step_k", "k_max", r6("h").alias("h"))


@query("mean_multiplier", "H20 A6", f"""{FIT}, {Q.first_levers('lv', P, 'app_id')}, {Q.personal('fl1', 'mu', P, 'pm')} SELECT app_id, round(avg(mult), 6) AS mean_mult, count(*) AS subs FROM pm GROUP BY 1""")
def mean_multiplier(spark, d):
    mx, st = fitted(spark, d)
    m = H.personal_multiplier(H.combos(mx, P, ["app_id"]), st.mult, P)
    return m.groupBy("app_id").agg(r6(F.sum(F.col("mult") * F.col("w")) / F.sum("w")).alias("mean_mult"), F.sum("w").alias("subs"))
