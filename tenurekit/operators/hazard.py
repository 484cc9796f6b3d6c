"""Hazard models: portfolio hazard, residual lever multipliers, shrunk ratios, mixture curves.

Everything runs on counts per (levers, step). State tables are long: hazard (step_k, h), multipliers
(lever, raw, cat, mult, n), ratios (group, hr). `by` adds key columns, so that all folds, cohorts or
cut-offs are fitted in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.functions.exprs import billday_bin, clip
from tenurekit.functions.ordered import cut
from tenurekit.params import Params


@dataclass
class State:
    """Fitted model: hazard by step and multipliers by lever category."""

    hazard: DataFrame
    mult: DataFrame


def lever_columns(mx: DataFrame, p: Params) -> DataFrame:
    """Lever columns, the same for fitting and predicting; billday_first belongs to the key's first step."""
    out = (mx.withColumn("billday_bin", billday_bin("billing_day_of_month"))
           .withColumn("billday_first", billday_bin("first_billing_day")))
    for c in set(p.levers) - {"billday_bin"}:
        out = out.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(none)")))
    return out


def app_step_rates(mx: DataFrame, p: Params, by: Sequence[str] = ()) -> DataFrame:
    """Survivors and rows at risk per application and step, where the sample is large enough."""
    r = mx.where(F.col("weeks_obs") >= F.col("step_k"))
    g = r.groupBy(*by, "app_id", "step_k").agg(F.sum("survived").alias("surv"), F.count(F.lit(1)).alias("n"))
    return g.where((F.col("n") >= p.min_risk) & (F.col("step_k") <= p.hmax))


def hazard_from_rates(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """1 - median over applications of the survival share, with the number of voting applications."""
    return rates.groupBy(*by, "step_k").agg(
        (1 - F.median(F.col("surv") / F.col("n"))).alias("h"), F.count(F.lit(1)).alias("votes"))


def portfolio_hazard(mx: DataFrame, p: Params, by: Sequence[str] = ()) -> DataFrame:
    return hazard_from_rates(app_step_rates(mx, p, by), by)


def mean_hazard(mx: DataFrame) -> DataFrame:
    """Uncensored share of steps that ended the chain."""
    return mx.groupBy("step_k").agg(F.avg(F.col("died").cast("double")).alias("h"), F.count(F.lit(1)).alias("n"))


def splice_hazard(own: DataFrame, p: Params, donor: DataFrame | None = None, by: Sequence[str] = (),
                  donors: Sequence[tuple[DataFrame, Sequence[str]]] = (), groups: DataFrame | None = None) -> DataFrame:
    """Own hazard up to the last step with enough votes (k_max), then the first donor that has the step, scaled to meet the own
    hazard at k_max (or that held flat without a donor); gaps filled forward and then backward, out to h_ext.

    `donors`: from the nearest to the widest, each with the key columns (among those of `groups`) that it has; `donor` is one without
    keys. `groups` (default: those of `own`): by and the donors' keys; a group without own votes has k_max 0 and follows its donors as
    they are. Without `groups` such a group has no rows."""
    names = [*by] or ["_one"]
    ladder = [*donors, *([(donor, ())] if donor is not None else [])]
    keys = [*dict.fromkeys([*names, *[k for _, ks in ladder for k in ks]])]
    every = own.select(*([*by] or [F.lit(0).alias("_one")])).distinct() if groups is None else groups.select(*keys).distinct()
    steps = every.withColumn("step_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(p.h_ext).cast("bigint"))))
    if not by:
        own = own.withColumn("_one", F.lit(0))
    s = steps.join(own.select(*names, "step_k", "h", "votes"), [*names, "step_k"], "left")
    for i, (d, ks) in enumerate(ladder):
        s = s.join(d.select(*ks, "step_k", F.col("h").alias(f"_d{i}")), [*ks, "step_k"], "left")
    allw = Window.partitionBy(*names)
    enough = (F.col("votes") >= p.min_cohorts) & (F.col("step_k") <= p.hmax)
    s = s.withColumn("k_max", F.coalesce(F.max(F.when(enough, F.col("step_k"))).over(allw), F.lit(0).cast("bigint")))
    at = F.col("step_k") == F.col("k_max")
    seam = {f"_s{c}": F.max(F.when(at, F.col(c))).over(allw) for c in ("h", *[f"_d{i}" for i in range(len(ladder))])}
    s = s.withColumns(seam)
    meets = [F.col(f"_d{i}") * F.coalesce(F.when(F.col(f"_s_d{i}") > 0, F.col("_sh") / F.col(f"_s_d{i}")), F.lit(1.0)) for i in range(len(ladder))]
    s = s.withColumn("h", F.when(F.col("step_k") <= F.col("k_max"), F.col("h")).otherwise(F.coalesce(*meets) if meets else F.col("_sh")))
    w = allw.orderBy("step_k")
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("h", F.coalesce(F.last("h", True).over(back), F.first("h", True).over(ahead)))
    return s.where(F.lit(groups is not None) | (F.col("k_max") > 0)).select(*by, "step_k", "h", "k_max")


def clean_cells(mx: DataFrame, p: Params, crash: DataFrame | None = None, by: Sequence[str] = (),
                keep: Sequence[str] = ()) -> DataFrame:
    """Rows and deaths per lever combination and step in the clean zone: early steps, old enough,
    without crashed applications."""
    z = lever_columns(mx, p).where(
        (F.col("step_k") <= p.clean_step_max) & (F.col("weeks_obs") >= F.col("step_k")))
    if crash is not None:
        z = z.join(crash.select("app_id"), "app_id", "left_anti")
    return z.groupBy(*by, *keep, *p.levers, "step_k").agg(
        F.count(F.lit(1)).alias("n"), F.sum("died").alias("died"))


def residual_multipliers(cells: DataFrame, hazard: DataFrame, p: Params, by: Sequence[str] = (),
                         levers: Sequence[str] | None = None) -> DataFrame:
    """Chain of multipliers: lever by lever, observed over expected deaths of each category, bounded,
    then folded into the expectation of the next lever. Rare categories share `other`.

    Per lever the cells are summed to one row per raw category, which combines before the shuffle; the
    small table of multipliers is joined back. The result has one row per raw category. The cells and
    the multipliers of every lever are written, so that a lever's plan does not hold those before it."""
    levers = list(levers if levers is not None else p.levers)
    c = cells.join(hazard.select(*by, "step_k", "h"), [*by, "step_k"], "left")
    c = c.withColumn("_exp", F.col("n") * F.col("h")).withColumn("_en", F.when(F.col("h").isNotNull(), F.col("n")))
    c = c.select(*by, *dict.fromkeys(levers), "n", "died", "_exp", "_en")
    c = cut(c) if levers else c
    out = None
    for lever in levers:
        raw = c.groupBy(*by, lever).agg(*[F.sum(m).alias(m) for m in ("n", "died", "_exp", "_en")])
        raw = raw.withColumn("cat", F.when(F.col("n") < p.min_rows, "other").otherwise(F.col(lever)))
        cat = raw.groupBy(*by, "cat").agg(clip(F.try_divide(
            F.sum("died") / F.sum("n"), F.try_divide(F.sum("_exp"), F.sum("_en"))), *p.clip).alias("mult"))
        raw = cut(match(raw, cat, [*by, "cat"]).select(*by, F.lit(lever).alias("lever"), F.col(lever).alias("raw"), "cat", "mult", "n"))
        out = raw if out is None else out.unionByName(raw)
        if lever != levers[-1]:
            c = match(c, raw.select(*by, F.col("raw").alias(lever), "mult"), [*by, lever])
            c = cut(c.withColumn("_exp", F.col("_exp") * F.coalesce("mult", F.lit(1.0))).drop("mult"))
    if out is None:
        return cells.sparkSession.createDataFrame([], "lever string, raw string, cat string, mult double, n bigint")
    return out


def match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which null keys match null keys."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, cond, "left").drop(*[f"_r_{k}" for k in keys])


def multiplier_categories(mult: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per fitted category (raw spellings folded together)."""
    return mult.groupBy(*by, "lever", "cat").agg(F.first("mult").alias("mult"), F.sum("n").alias("n"))


def multiplier_sanity(mult: DataFrame, p: Params) -> DataFrame:
    """Row-weighted mean multiplier of each lever and whether it sits near 1."""
    cats = multiplier_categories(mult).withColumn("_w", F.col("mult") * F.col("n"))
    collapsed = mult.groupBy("lever").agg(F.count_if((F.col("cat") == "other") & (F.col("raw") != "other")).alias("collapsed"))
    g = cats.groupBy("lever").agg((F.sum("_w") / F.sum("n")).alias("weighted_mean"),
                                  F.count(F.lit(1)).alias("categories"), F.sum("n").alias("rows"))
    return g.join(collapsed, "lever").withColumn("ok", F.col("weighted_mean").between(*p.sanity))


def fit(mx: DataFrame, p: Params, crash: DataFrame | None = None, donor: DataFrame | None = None,
        splice: bool = False) -> State:
    """Portfolio hazard on all rows and the multiplier chain on the clean zone."""
    h = portfolio_hazard(mx, p)
    if splice:
        h = splice_hazard(h, p, donor)
    return State(h, residual_multipliers(clean_cells(mx, p, crash), h, p))


def combos(mx: DataFrame, p: Params, by: Sequence[str]) -> DataFrame:
    """Subscriptions per lever combination of each group; levers are those of the first step."""
    first = _first_levers(p)
    per = lever_columns(mx, p).groupBy(*by, "sub_id").agg(*[F.min_by(c, "step_k").alias(lv) for lv, c in first])
    return per.groupBy(*by, *p.levers).agg(F.count(F.lit(1)).alias("w"))


def _first_levers(p: Params):
    return [(lv, "billday_first" if lv == "billday_bin" else lv) for lv in p.levers]


def personal_multiplier(cells: DataFrame, mult: DataFrame, p: Params, by: Sequence[str] = (),
                        levers: Sequence[str] | None = None) -> DataFrame:
    """Bounded product of the multipliers of each row's categories (`mult`); unknown ones count 1."""
    levers = list(levers if levers is not None else p.levers)
    if not levers:
        return cells.withColumn("mult", F.lit(1.0))
    key = [*by, *levers]
    combo = cells.select(*key).distinct()
    long = combo.withColumn("_s", F.explode(F.array(*[
        F.struct(F.lit(lv).alias("lever"), F.col(lv).alias("raw")) for lv in levers])))
    long = long.select(*key, F.col("_s.lever").alias("lever"), F.col("_s.raw").alias("raw"))
    m = mult.select(*by, "lever", "raw", F.col("mult").alias("_m"))
    prod = long.join(m, [*by, "lever", "raw"], "left").groupBy(*key).agg(
        F.product(F.coalesce(F.col("_m"), F.lit(1.0))).alias("_p"))
    return cells.join(prod.withColumn("mult", clip("_p", *p.clip)).drop("_p"), key)


def ratio_cells(mx: DataFrame, p: Params, by: Sequence[str]) -> DataFrame:
    """Rows and deaths per group, step and first-step levers, for steps old enough to be judged."""
    z = lever_columns(mx, p).where(F.col("weeks_obs") >= F.col("step_k") + 1)
    return z.groupBy(*by, "step_k", *[F.col(c).alias(lv) for lv, c in _first_levers(p)]).agg(
        F.count(F.lit(1)).alias("n"), F.sum("died").alias("died"))


def hazard_ratio(cells: DataFrame, state: State, p: Params, by: Sequence[str],
                 weeks: Sequence[int] | None = None, state_by: Sequence[str] = (),
                 levers: Sequence[str] | None = None) -> DataFrame:
    """Shrunk ratio of observed to expected deaths per group, optionally per number of visible weeks.

    Expectation is hazard x personal multiplier, so that levers are not learnt twice. The size that
    shrinks counts all rows, also those of steps left out for being thin."""
    e = personal_multiplier(cells, state.mult, p, state_by, levers)
    e = e.join(state.hazard.select(*state_by, "step_k", "h"), [*state_by, "step_k"], "left")
    e = e.withColumn("_x", clip(F.col("h") * F.col("mult"), *p.hazard_clip))
    per = e.groupBy(*by, "step_k").agg(
        F.sum("n").alias("n"), F.sum("died").alias("d"), F.sum(F.col("n") * F.col("_x")).alias("x"),
        F.sum(F.when(F.col("_x").isNotNull(), F.col("n"))).alias("xn"))
    if weeks is not None:
        per = per.withColumn("weeks", F.explode(F.array(*[F.lit(int(w)).cast("bigint") for w in weeks])))
        per, by = per.where(F.col("step_k") <= F.col("weeks")), [*by, "weeks"]
    return _shrunk(per, F.col("d") / F.col("n"), F.try_divide(F.col("x"), F.col("xn")), p, by)


def _shrunk(per: DataFrame, observed: Column, expected: Column, p: Params, by) -> DataFrame:
    use = (F.col("n") >= p.hr_min_n) & (expected > 0)
    log = F.ln(clip(F.try_divide(observed, expected), *p.oe_clip))
    g = per.groupBy(*by).agg(
        F.sum("n").alias("n_seen"),
        F.try_divide(F.sum(F.when(use, F.col("n") * log)), F.sum(F.when(use, F.col("n")))).alias("log_hr"))
    shrink = F.col("n_seen") / (F.col("n_seen") + F.lit(p.k_shrink))
    return g.withColumn("hr", F.exp(F.coalesce("log_hr", F.lit(0.0)) * shrink)).drop("log_hr")


def hazard_array(hazard: DataFrame, length: int) -> Column:
    """The hazard curve as one array value (at most `length` entries) from a one-row subquery."""
    pairs = F.collect_list(F.struct("step_k", "h"))
    return hazard.where(F.col("step_k") <= length).agg(F.map_from_entries(pairs)).scalar()


def mixture_curve(groups: DataFrame, hazard: DataFrame, p: Params, by: Sequence[str], length: int | None = None,
                  state_by: Sequence[str] = (), gap: str = "null") -> DataFrame:
    """Survival of each group: weighted mean over its combinations (w, mult, hr) of the running
    product of 1 - bounded hazard. `gap` says what a missing hazard does: null ends the curve, zero
    counts as no risk."""
    length = length or p.hmax
    g = groups.withColumn("_r", F.col("mult") * F.col("hr"))
    if state_by:
        arr = hazard.where(F.col("step_k") <= length).groupBy(*state_by).agg(
            F.map_from_entries(F.collect_list(F.struct("step_k", "h"))).alias("_hm"))
        g = g.join(arr, [*state_by])
    else:
        g = g.withColumn("_hm", hazard_array(hazard, length))
    steps = F.sequence(F.lit(1).cast("bigint"), F.lit(length).cast("bigint"))
    lo, hi = (F.lit(x) for x in p.hazard_clip)

    def alive(k):
        x = F.try_element_at("_hm", k) * F.col("_r")
        x = F.when(x < lo, lo).when(x > hi, hi).otherwise(x)
        return 1 - (F.coalesce(x, F.lit(0.0)) if gap == "zero" else x)

    init = F.struct(F.lit(1.0).alias("s"), F.array().cast("array<double>").alias("a"))
    run = F.aggregate(steps, init, lambda acc, k: F.struct(
        (acc["s"] * alive(k)).alias("s"), F.concat(acc["a"], F.array(acc["s"] * alive(k))).alias("a")))
    rows = g.select(*by, "w", F.posexplode(run["a"]).alias("_pos", "_s"))
    return rows.groupBy(*by, (F.col("_pos") + 1).cast("bigint").alias("k")).agg(
        F.when(F.count_if(F.col("_s").isNull()) == 0, F.sum(F.col("w") * F.col("_s")) / F.sum("w")).alias("s"))


def predict(mx: DataFrame, state: State, p: Params, by: Sequence[str] = ("app_id",),
            weeks: Sequence[int] | None = None, length: int | None = None, gap: str = "null") -> DataFrame:
    """Survival curve of every group (and number of visible weeks) in one job."""
    hr = hazard_ratio(ratio_cells(mx, p, by), state, p, by, weeks)
    mix = personal_multiplier(combos(mx, p, by), state.mult, p)
    if weeks is not None:
        mix = mix.withColumn("weeks", F.explode(F.array(*[F.lit(int(w)).cast("bigint") for w in weeks])))
        by = [*by, "weeks"]
    mix = mix.join(hr, [*by], "left").withColumn("hr", F.coalesce("hr", F.lit(1.0)))
    return mixture_curve(mix, state.hazard, p, by, length, gap=gap)


def empirical_ratio(mx: DataFrame, hazard: DataFrame, p: Params, by: Sequence[str], weeks: Sequence[int]) -> DataFrame:
    """Ratio against the bare portfolio hazard; the size counts rows before censoring."""
    z = mx.withColumn("_ok", F.col("weeks_obs") >= F.col("step_k")).groupBy(*by, "step_k").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if("_ok").alias("n"),
        F.sum(F.when(F.col("_ok"), F.col("died"))).alias("d"))
    z = z.join(hazard.select("step_k", "h"), "step_k", "left").withColumn(
        "weeks", F.explode(F.array(*[F.lit(int(w)).cast("bigint") for w in weeks]))).where(F.col("step_k") <= F.col("weeks"))
    use = (F.col("n") >= p.hr_min_n) & (F.col("h") > 0) & (F.col("step_k") <= p.hmax)
    log = F.ln(clip(F.try_divide(F.try_divide("d", "n"), "h"), *p.oe_clip))
    g = z.groupBy(*by, "weeks").agg(F.sum("n_all").alias("n_seen"), F.try_divide(
        F.sum(F.when(use, F.col("n") * log)), F.sum(F.when(use, F.col("n")))).alias("lr"))
    return g.withColumn("hr", F.exp(F.coalesce("lr", F.lit(0.0)) * F.col("n_seen") / (F.col("n_seen") + F.lit(p.k_shrink)))).drop("lr")


def empirical_predict(mx: DataFrame, p: Params, by: Sequence[str] = ("app_id",), weeks: Sequence[int] = (4,)) -> DataFrame:
    h = portfolio_hazard(mx, p)
    hr = empirical_ratio(mx, h, p, by, weeks).withColumns({"mult": F.lit(1.0), "w": F.lit(1).cast("bigint")})
    return mixture_curve(hr, h, p, [*by, "weeks"], gap="zero")
