"""Calibrating and extrapolating curves. Inputs are cohort or step tables of at most a few hundred
rows per key; regressions are closed-form sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.functions.exprs import clip
from tenurekit.operators.survival import grid


def _key(by: Sequence[str]) -> list:
    return [*by] if by else [F.lit(0)]


def pooled_hazard(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """At risk and died per rebill, pooled over the cohorts mature at it."""
    w = Window.partitionBy(*by, "cohort").orderBy("rebill_number")
    f = facts.withColumn("_prev", F.lag("active_users").over(w)).where("rebill_number >= 1")
    g = f.groupBy(*by, F.col("rebill_number").alias("k")).agg(
        F.sum("_prev").alias("n_at_risk"), F.sum(F.col("_prev") - F.col("active_users")).alias("died"))
    return g.withColumn("h", F.try_divide("died", "n_at_risk"))


def log_linear_fit(pooled: DataFrame, ref: DataFrame, min_n: int = 40, by: Sequence[str] = ()) -> DataFrame:
    """Weighted fit of log(h / h_ref) = alpha + beta (k - 1) over steps with enough at risk."""
    r = pooled.join(ref.select(F.col("step_k").alias("k"), F.col("h").alias("h_ref")), "k").where(F.col("n_at_risk") >= min_n)
    x = (F.col("k") - 1).cast("double")
    y = F.ln(F.try_divide("h", "h_ref"))
    w = F.when(y.isNotNull(), F.col("n_at_risk").cast("double"))
    g = r.groupBy(*by).agg(F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
                           F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.max("k").alias("k_max"))
    beta = F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    g = g.withColumn("beta", beta)
    return g.select(*by, ((F.col("sy") - F.col("beta") * F.col("sx")) / F.col("sw")).alias("alpha"), "beta", "k_max")


def correction(fit: DataFrame, hmax: int, taper: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Correction by step: fitted inside, a straight fade to 1 over `taper` steps, 1 beyond."""
    g = grid(fit, "step_k", 1, hmax)
    k, top = F.col("step_k"), F.col("k_max")
    inside = F.exp(F.col("alpha") + F.col("beta") * (k - 1))
    edge = F.exp(F.col("alpha") + F.col("beta") * (top - 1))
    frac = (k - top) / F.lit(float(taper + 1))
    c = F.when(k <= top, inside).when(k <= top + taper, edge * (1 - frac) + frac).otherwise(1.0)
    return g.select(*by, "step_k", c.alias("c"))


def corrected_hazard(ref: DataFrame, corr: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return corr.join(ref.select("step_k", F.col("h").alias("h0")), "step_k").select(
        *by, "step_k", (F.col("h0") * F.col("c")).alias("h"))


def pointwise_hazard(pooled: DataFrame, hmax: int, min_n: int = 40, by: Sequence[str] = ()) -> DataFrame:
    """Pooled hazard where enough are at risk; elsewhere the last reliable value, held flat."""
    last = F.max_by("h", F.when(F.col("n_at_risk") >= min_n, F.col("k")))
    fall = F.max_by("h", F.col("k"))
    anchor = pooled.groupBy(*by).agg(F.coalesce(last, fall).alias("_flat")) if by else pooled.agg(F.coalesce(last, fall).alias("_flat"))
    g = grid(anchor, "step_k", 1, hmax)
    j = g.join(pooled.select(*by, F.col("k").alias("step_k"), "h", "n_at_risk"), [*by, "step_k"], "left")
    ok = F.coalesce(F.col("n_at_risk") >= min_n, F.lit(False))
    return j.select(*by, "step_k", F.when(ok, F.col("h")).otherwise(F.col("_flat")).alias("h"))


def survival_of(hazard: DataFrame, by: Sequence[str] = (), bounds: tuple[float, float] = (0.001, 0.999)) -> DataFrame:
    """Running product of 1 - h over steps, the hazard kept inside its bounds."""
    w = Window.partitionBy(*_key(by)).orderBy("step_k").rowsBetween(Window.unboundedPreceding, 0)
    return hazard.select(*by, F.col("step_k").alias("k"), F.exp(F.sum(F.log1p(-clip("h", *bounds))).over(w)).alias("s"))


def growth_shape(survival: DataFrame, arpu: Column | float, hmax: int, h_ext: int, tail: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative value by payment: the first payment in full, then survival times ARPU; beyond hmax
    a straight line with the mean of the last increments. Adds the payments-only curve at every
    fourth step through ups_value."""
    a = F.lit(arpu) if isinstance(arpu, (int, float)) else arpu
    s = survival.select(*by, "k", F.coalesce(F.col("s") * a, F.lit(0.0)).alias("inc"))
    g = grid(survival.select(*by, F.lit(1).alias("_1")).distinct(), "k", 0, h_ext)
    j = g.join(s, [*by, "k"], "left")
    allw = Window.partitionBy(*_key(by))
    mean = F.sum(F.when((F.col("k") > hmax - tail) & (F.col("k") <= hmax), F.col("inc"))).over(allw) / F.lit(float(tail))
    j = j.withColumn("_m", mean).withColumn("inc", F.when(F.col("k") == 0, a).when(F.col("k") <= hmax, F.coalesce("inc", F.lit(0.0))).otherwise(F.col("_m")))
    w = allw.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("value", F.sum("inc").over(w))
    return j.select(*by, "k", "inc", "value")


def cycle_curve(shape: DataFrame, price: float, every: int, by: Sequence[str] = ()) -> DataFrame:
    """Charges expected by step when charged every `every` steps: survival implied by the shape,
    sampled at these steps; other steps hold the last one."""
    on = F.col("k") % every == 0
    one = F.when(F.col("k") == 0, 1.0).when(on, F.col("inc") / F.lit(price)).otherwise(0.0)
    w = Window.partitionBy(*_key(by)).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return shape.withColumn("ups_value", F.sum(one).over(w))


def shape_ratio(shape: DataFrame, pairs: DataFrame, h_ext: int) -> DataFrame:
    """value[target] / value[anchor] for pairs (target, anchor), both kept inside the curve."""
    v = shape.select("k", "value")
    lim = F.lit(h_ext).cast("bigint")
    p = pairs.withColumn("_t", F.least(F.greatest("target", F.lit(0).cast("bigint")), lim)).withColumn(
        "_a", F.least(F.greatest("anchor", F.lit(0).cast("bigint")), lim))
    j = p.join(v.select(F.col("k").alias("_t"), F.col("value").alias("_vt")), "_t").join(
        v.select(F.col("k").alias("_a"), F.col("value").alias("_va")), "_a")
    base = F.when(F.col("_a") > 0, F.col("_va")).otherwise(F.lit(1e-9))
    return j.select("target", "anchor", F.when(base > 0, F.col("_vt") / base).otherwise(1.0).alias("ratio"))


def anchored(model: DataFrame, facts: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Model curve scaled so that it meets the fact at the anchor (facts: by, anchor, fact)."""
    j = model.join(facts, [*by])
    at = F.max(F.when(F.col("k") == F.col("anchor"), F.col(value))).over(Window.partitionBy(*by))
    return j.withColumn("_at", at).withColumn(
        "anchored", F.col(value) * F.when(F.col("_at") > 0, F.col("fact") / F.nullif(F.col("_at"), F.lit(0.0))).otherwise(1.0)).drop("_at")


def smoothed_increments(curve: DataFrame, smooth: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """Trailing mean of week-over-week increments; needs half a window of them, two at least."""
    top = curve.groupBy(*by).agg(F.max("week").alias("_t")) if by else curve.agg(F.max("week").alias("_t"))
    g = grid(top, "week", 0, F.col("_t")).join(curve.select(*by, "week", "cum_avg"), [*by, "week"], "left")
    o = Window.partitionBy(*_key(by)).orderBy("week")
    g = g.withColumn("inc", F.col("cum_avg") - F.lag("cum_avg").over(o))
    w = o.rowsBetween(-(smooth - 1), 0)
    enough = F.count("inc").over(w) >= max(2, smooth // 2)
    return g.select(*by, "week", "inc", F.when(enough, F.avg("inc").over(w)).alias("smoothed"))


def decay_fit(smoothed: DataFrame, lo: Column | int, hi: Column | int, by: Sequence[str] = (), min_points: int = 4) -> DataFrame:
    """a and r of increment(w) = a r^w over [lo, hi]; over all weeks when too few are positive there,
    or when the fit does not decay."""
    pos = smoothed.where("smoothed > 0")
    x, y = F.col("week").cast("double"), F.ln("smoothed")
    inside = (F.col("week") >= lo) & (F.col("week") <= hi)

    def fit(cond, tag):
        yy, xx = F.when(cond, y), F.when(cond, x)
        return [F.regr_slope(yy, xx).alias(f"s{tag}"), F.regr_intercept(yy, xx).alias(f"i{tag}"), F.count(yy).alias(f"n{tag}")]

    aggs = fit(inside, "w") + fit(F.lit(True), "a")
    g = pos.groupBy(*by).agg(*aggs) if by else pos.agg(*aggs)
    wide = (F.col("nw") < min_points) | (F.col("sw") >= 0)
    slope = F.when(wide, F.col("sa")).otherwise(F.col("sw"))
    inter = F.when(wide, F.col("ia")).otherwise(F.col("iw"))
    return g.where("na >= 3").select(*by, F.exp(inter).alias("a"), F.exp(slope).alias("r"), F.col("nw").alias("points"), wide.alias("widened"))


def extrapolate(anchors: DataFrame, to_week: int, by: Sequence[str] = ()) -> DataFrame:
    """Observed value at the anchor plus the decaying increments after it.

    anchors: by, anchor_week, anchor_value, a, r."""
    g = grid(anchors, "week", F.col("anchor_week") + 1, F.lit(to_week).cast("bigint"))
    inc = F.col("a") * F.pow("r", F.col("week").cast("double"))
    w = Window.partitionBy(*_key(by)).orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return g.select(*by, "week", (F.col("anchor_value") + F.sum(inc).over(w)).alias("cum"))


def truncation_test(curves: DataFrame, sizes: DataFrame, cut_week: int, target_week: int, by: Sequence[str],
                    fit_weeks: int = 8, smooth: int = 3, min_n: int = 100, fallback_n: int = 50) -> DataFrame:
    """Per cohort: extrapolate from the truncated curve and compare with what came; the size floor
    drops to the fallback when fewer than two cohorts pass it. Adds the overall band."""
    short = curves.where(F.col("week") <= cut_week)
    fit = decay_fit(smoothed_increments(short, smooth, by), cut_week - fit_weeks + 1, cut_week, by)
    v = curves.groupBy(*by).agg(F.max(F.when(F.col("week") == cut_week, F.col("cum_avg"))).alias("anchor_value"),
                                F.max(F.when(F.col("week") == target_week, F.col("cum_avg"))).alias("actual"))
    a = fit.join(v, [*by]).join(sizes.select(*by, "size"), [*by]).where("anchor_value is not null and actual is not null")
    a = a.withColumn("anchor_week", F.lit(cut_week).cast("bigint"))
    steps = grid(a, "week", F.col("anchor_week") + 1, F.lit(target_week).cast("bigint"))
    t = steps.groupBy(*by, "size", "actual", "anchor_value").agg(F.sum(F.col("a") * F.pow("r", F.col("week").cast("double"))).alias("_i"))
    t = t.select(*by, "size", "actual", (F.col("anchor_value") + F.col("_i")).alias("predicted"))
    t = t.withColumn("rel_err", F.try_divide(F.col("predicted") - F.col("actual"), "actual"))
    w = Window.partitionBy(F.lit(0))
    floor = F.when(F.count_if(F.col("size") >= min_n).over(w) >= 2, F.lit(min_n)).otherwise(F.lit(fallback_n))
    t = t.withColumn("min_size", floor.cast("bigint")).where(F.col("size") >= F.col("min_size"))
    return t.withColumn("band", F.max(F.abs("rel_err")).over(w))


def ratio_curve(person: DataFrame, sub: DataFrame, hmax: int, min_n: int = 40) -> DataFrame:
    """Person over subscription value by week, the last value held flat to hmax.

    person: week, n, person_ltv. sub: week, sub_ltv."""
    j = person.join(sub, "week").withColumn("ratio", F.col("person_ltv") / F.col("sub_ltv"))
    last = F.max_by("ratio", F.when(F.col("n") >= min_n, F.col("week")))
    flat = j.agg(last.alias("_flat"))
    g = grid(flat, "week", 0, hmax).join(j.select("week", "ratio"), "week", "left")
    w = Window.partitionBy(F.lit(0)).orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("week", F.coalesce(F.last("ratio", True).over(w), F.col("_flat")).alias("ratio"))


def spread_band(model: DataFrame, value: str, share: float) -> DataFrame:
    """Model with a symmetric relative band."""
    return model.withColumns({"lower": F.col(value) * (1 - share), "upper": F.col(value) * (1 + share)})
