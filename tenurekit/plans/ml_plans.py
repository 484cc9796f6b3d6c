"""Logistic survival models on the step matrix of the driver's orders (curves are rows-only; score equations, closed forms and the calibration of fixed scores have SQL)."""

from pyspark.sql import functions as F

from tenurekit.functions.ordered import cut
from tenurekit.operators import ml as M
from tenurekit.params import ORDERS as P
from tenurekit.plans.ladder_plans import OMX, orders_mx
from tenurekit.plans.registry import query
from tenurekit.sources.adapters import table


def model(spark, d):
    mx = orders_mx(spark, d)
    return mx, M.fit(mx, P)


@query("logistic_survival", "H13 F12")
def logistic_survival(spark, d):
    mx, m = model(spark, d)
    return M.predict(mx, m, P, ["app_id"], P.seen_weeks).select("app_id", "weeks", "k", F.round("s", 6).alias("s"))


@query("hybrid_survival", "H14")
def hybrid_survival(spark, d):
    mx, m = model(spark, d)
    return M.hybrid_predict(mx, m, P, 1, ["app_id"], P.seen_weeks).select("app_id", "weeks", "k", F.round("s", 6).alias("s"))


@query("hybrid_v2_survival", "H15")
def hybrid_v2_survival(spark, d):
    mx, m = model(spark, d)
    return M.hybrid_predict(mx, m, P, 2, ["app_id"], P.seen_weeks).select("app_id", "weeks", "k", F.round("s", 6).alias("s"))


@query("multiplier_vs_risk", "H20")
def multiplier_vs_risk(spark, d):
    from tenurekit.operators import hazard as H
    mx, m = model(spark, d)
    st = H.fit(mx, P)
    mean = H.personal_multiplier(H.combos(mx, P, ["app_id"]), st.mult, P).groupBy("app_id").agg((F.sum(F.col("mult") * F.col("w")) / F.sum("w")).alias("map_mean_mult"))
    return M.relative_risk(mx, m, P, 2).join(mean, "app_id").select("app_id", F.round("rr", 6).alias("rr"), F.round("map_mean_mult", 6).alias("map_mean_mult"))


_CATS = ("geo", "media_source", "attribution_source", "plan_interval", "cohort_month")
_TRAIN = f"""{OMX}, z AS (SELECT *, least(step_k, {P.hmax})::VARCHAR AS step_bin, coalesce(trial_days, -1)::DOUBLE AS td, 1.0::DOUBLE / count(*) OVER (PARTITION BY app_id) AS aw FROM mx WHERE weeks_obs >= step_k + 1),
 ct AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS category, survived, aw FROM z" for c in ('step_bin', *_CATS))}),
 cn AS (SELECT feature, CASE WHEN count(*) OVER (PARTITION BY feature, category) < 50 THEN 'infrequent' ELSE category END AS category, survived, aw FROM ct)"""


def _equations(m: M.Model, mx, weight=None):
    z = M.features(mx, m.tops, P).where(F.col("weeks_obs") >= F.col("step_k") + 1).withColumn("_w", F.lit(1.0) if weight is None else weight)
    return M.score_equations(M._cells(z, M.CATS), m.pipeline)


@query("logistic_score_equations", "H13", f"""{_TRAIN} SELECT feature, category, count(*) AS n, sum(survived)::DOUBLE AS survivors, sum(survived)::DOUBLE AS fitted FROM cn GROUP BY 1, 2
 UNION ALL SELECT 'billing_day_of_month', 'value', count(*), sum(survived * billing_day_of_month)::DOUBLE, sum(survived * billing_day_of_month)::DOUBLE FROM z UNION ALL SELECT 'trial_days', 'value', count(*), sum(survived * td), sum(survived * td) FROM z""")
def logistic_score_equations(spark, d):
    """At the optimum the expected survivors of every feature, plus the penalty's share, are the counted ones."""
    mx, m = model(spark, d)
    return _equations(m, mx).select("feature", "category", "n", F.round("survivors", 0).alias("survivors"), F.round("fitted", 0).alias("fitted"))


@query("equal_app_equations", "H16", f"""{_TRAIN} SELECT feature, category, count(*) AS n, round(sum(survived * aw), 2) AS survivors, round(sum(survived * aw), 2) AS fitted FROM cn GROUP BY 1, 2""")
def equal_app_equations(spark, d):
    """The same with every application weighing the same."""
    mx = cut(M.equal_app_weight(orders_mx(spark, d).where(F.col("weeks_obs") >= F.col("step_k") + 1)))
    e = _equations(M.fit(mx, P, F.col("app_weight")), mx, F.col("app_weight")).where("category <> 'value'")
    return e.select("feature", "category", "n", F.round("survivors", 2).alias("survivors"), F.round("fitted", 2).alias("fitted"))


@query("logistic_closed_form", "H13 H17", f"""{_TRAIN} SELECT 'step_bin' AS feature, step_bin AS category, count(*) AS n, round(avg(survived), 4) AS p FROM z GROUP BY step_bin
 UNION ALL SELECT 'media_source', media_source, count(*), round(avg(survived), 4) FROM z GROUP BY media_source""")
def logistic_closed_form(spark, d):
    """A model of one category without a penalty gives every category its own share."""
    mx = orders_mx(spark, d)
    tops = cut(M.top_categories(mx, ("geo", "media_source", "attribution_source")))
    z = M.features(mx, tops, P).where(F.col("weeks_obs") >= F.col("step_k") + 1).withColumn("label", F.col("survived").cast("double"))
    out = None
    for c in ("step_bin", "media_source"):
        cells = cut(z.groupBy(c, "label").agg(F.count(F.lit(1)).cast("double").alias("w"), F.count(F.lit(1)).alias("n")))
        one = M.survive(M._fit_cells(cells, 0, [c], [], 0.0), cells.groupBy(c).agg(F.sum("n").alias("n")))
        one = one.select(F.lit(c).alias("feature"), F.col(c).alias("category"), "n", F.round("p", 4).alias("p"))
        out = one if out is None else out.unionByName(one)
    return out


@query("equal_app_logistic", "H16")
def equal_app_logistic(spark, d):
    mx = cut(M.equal_app_weight(orders_mx(spark, d).where(F.col("weeks_obs") >= F.col("step_k") + 1)))
    m = M.fit(mx, P, F.col("app_weight"))
    return M.predict(mx, m, P, ["app_id"], (4,)).select("app_id", "weeks", "k", F.round("s", 6).alias("s"))


@query("feature_baseline", "H17")
def feature_baseline(spark, d):
    b = M.baseline(orders_mx(spark, d), P)
    return b.scores.select(*[F.round(c, 5).alias(c) for c in ("auc", "log_loss", "brier", "base_rate")], "n")


@query("baseline_steps", "H17")
def baseline_steps(spark, d):
    return M.baseline(orders_mx(spark, d), P).steps.select("step_bin", F.round("coefficient", 5).alias("coefficient"))


@query("decile_calibration", "A15", """WITH t AS (SELECT l_extendedprice / 110000::DOUBLE AS p, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS label FROM lineitem),
 e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM t)
 SELECT len(list_filter(q, lambda x: x < p)) AS bin, round(avg(p), 5) AS pred, round(avg(label), 5) AS real, count(*) AS n FROM t, e GROUP BY 1""")
def decile_calibration(spark, d):
    """Fixed scores made of a line's price, against whether the line came back."""
    li = table(spark, d, "lineitem", "l_extendedprice", "l_returnflag")
    t = li.select((F.col("l_extendedprice") / 110000).alias("p"), (F.col("l_returnflag") == "R").cast("double").alias("label"), F.lit(1).alias("w"))
    return M.calibration(t).select("bin", F.round("pred", 5).alias("pred"), F.round("real", 5).alias("real"), "n")


@query("model_calibration", "H17 A15")
def model_calibration(spark, d):
    b = M.baseline(orders_mx(spark, d), P)
    return b.calibration.select("bin", F.round("pred", 5).alias("pred"), F.round("real", 5).alias("real"), "n")
