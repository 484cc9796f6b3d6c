"""Scoring forecasts: accuracy grids, leave-one-out folds, calendar and segment backtests.

Folds, cut-offs and visible weeks are key columns, so every refit happens in the same job on
pre-aggregated cells. The number of folds is the number of selected applications or cohorts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.functions.exprs import clip, periods_between, whole_days
from tenurekit.operators import calibrate as C
from tenurekit.operators import hazard as H
from tenurekit.operators import ladder as L
from tenurekit.operators import ltv as V
from tenurekit.operators import revenue as R
from tenurekit.operators import survival as S
from tenurekit.operators import views as VW
from tenurekit.params import Params


def weeks_array(weeks: Sequence[int]) -> Column:
    return F.explode(F.array(*[F.lit(int(w)).cast("bigint") for w in weeks]))


# ------------------------------------------------------------------ step test
def score(predictions: DataFrame, facts: DataFrame, p: Params, keys: Sequence[str] = ("app_id",)) -> DataFrame:
    """Relative errors of survival predictions where the fact is mature, positive and not crashed."""
    f = facts.where(~F.col("crash") & (F.col("mature") >= p.min_mature) & (F.col("fact") > 0))
    j = predictions.join(f.select(*keys, "k", "fact", "mature"), [*keys, "k"]).where(F.col("k").isin(*p.horizons))
    err = (F.col("s") - F.col("fact")) / F.col("fact")
    return j.withColumnRenamed("k", "horizon").withColumn("signed_err", err).withColumn("abs_err", F.abs("signed_err"))


def accuracy_grid(detail: DataFrame, by: Sequence[str] = ("model", "weeks", "horizon")) -> DataFrame:
    """Median absolute and signed error per cell of the grid."""
    return detail.groupBy(*by).agg(F.median("abs_err").alias("abs_err"), F.median("signed_err").alias("signed_err"),
                                   F.count(F.lit(1)).alias("n"))


def step_against_calendar(step: DataFrame, calendar: DataFrame) -> DataFrame:
    """Median absolute errors per model and horizon of the step test and of the calendar test."""
    by = ["model", "horizon"]
    a = accuracy_grid(step, by).select(*by, F.col("abs_err").alias("step_err"), F.col("n").alias("step_n"))
    b = accuracy_grid(calendar, by).select(*by, F.col("abs_err").alias("calendar_err"), F.col("n").alias("calendar_n"))
    return a.join(b, by, "full").withColumn("gap", F.col("calendar_err") - F.col("step_err"))


def winners(grid: DataFrame) -> DataFrame:
    """Per horizon: the model with the lowest median over visible weeks."""
    m = grid.groupBy("model", "horizon").agg(F.median("abs_err").alias("err"))
    return m.groupBy("horizon").agg(F.min_by("model", F.struct("err", "model")).alias("winner"), F.min("err").alias("err"))


def all_models(mx: DataFrame, state: H.State, p: Params) -> DataFrame:
    a = H.predict(mx, state, p, ["app_id"], p.seen_weeks).withColumn("model", F.lit("map"))
    b = H.empirical_predict(mx, p, ["app_id"], p.seen_weeks).withColumn("model", F.lit("empirical"))
    return a.unionByName(b.select(*a.columns))


# ------------------------------------------------------------------ leave one out
def _folds(names: DataFrame, c: str) -> Column:
    """The fold names as one array value (one entry per selected application or cohort)."""
    return names.agg(F.collect_set(c)).scalar()


def without_own(cells: DataFrame, folds: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Sums over all applications but the fold's own: the total minus its own part, one row per fold and cell."""
    keys = [c for c in cells.columns if c not in ("app_id", *sums)]
    total = cells.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in sums])
    own = (cells.join(folds.select("app_id"), "app_id", "left_semi").withColumnRenamed("app_id", "fold")
           .groupBy("fold", *keys).agg(*[F.sum(x).alias(f"_{x}") for x in sums]))
    grid = H.match(total.withColumn("fold", F.explode(_folds(folds, "app_id"))), own, ["fold", *keys])
    rest = [(F.col(x) - F.coalesce(f"_{x}", F.lit(0))).alias(x) for x in sums]
    return grid.select("fold", *keys, *rest).where(F.col(sums[0]) > 0)


def loo_hazard(rates: DataFrame, folds: DataFrame) -> DataFrame:
    """Per fold and step: 1 - median over the other applications, and their number. A step's shares are
    sorted once, one entry per application; a fold's median skips the place of its own share."""
    share = rates.select("app_id", "step_k", (F.col("surv") / F.col("n")).alias("_own"))
    steps = share.groupBy("step_k").agg(F.array_sort(F.collect_list("_own")).alias("_s"))
    own = share.withColumnRenamed("app_id", "fold")
    g = steps.withColumn("fold", F.explode(_folds(folds, "app_id"))).join(own, ["fold", "step_k"], "left")
    has = F.col("_own").isNotNull()
    n = F.size("_s") - has.cast("int")
    place = F.array_position("_s", F.col("_own"))  # from 1

    def rest(i: Column) -> Column:
        return F.get("_s", F.when(has & (i >= place - 1), i + 1).otherwise(i).cast("int"))

    g = g.withColumn("votes", n.cast("bigint")).where("votes > 0")
    return g.select("fold", "step_k", (1 - (rest(F.floor((n - 1) / 2)) + rest(F.floor(n / 2))) / 2).alias("h"), "votes")


def loo_fit(mx: DataFrame, p: Params, folds: DataFrame, crash: DataFrame | None = None,
            donor: DataFrame | None = None, splice: bool = False, levers: Sequence[str] | None = None) -> H.State:
    """One state per fold, each without that fold's application."""
    h = loo_hazard(V.cut(H.app_step_rates(mx, p)), folds)
    if splice:
        h = H.splice_hazard(V.cut(h), p, donor, ["fold"])
    h = V.cut(h)
    cells = without_own(V.cut(H.clean_cells(mx, p, crash, keep=["app_id"])), folds, ["n", "died"])
    return H.State(h, H.residual_multipliers(cells, h, p, ["fold"], levers))


def loo_predict(mx: DataFrame, state: H.State, p: Params, weeks: Sequence[int]) -> DataFrame:
    """Each application predicted by the state that never saw it."""
    cells = H.ratio_cells(mx, p, ["app_id"]).withColumn("fold", F.col("app_id"))
    cells = cells.join(state.hazard.select("fold").distinct(), "fold", "left_semi")
    hr = H.hazard_ratio(cells, state, p, ["fold"], weeks, ["fold"])
    mix = H.combos(mx, p, ["app_id"]).withColumnRenamed("app_id", "fold")
    mix = H.personal_multiplier(mix, state.mult, p, ["fold"]).withColumn("weeks", weeks_array(weeks))
    mix = mix.join(hr, ["fold", "weeks"], "left").withColumn("hr", F.coalesce("hr", F.lit(1.0)))
    return H.mixture_curve(mix, state.hazard, p, ["fold", "weeks"], state_by=["fold"]).withColumnRenamed("fold", "app_id")


def paired_delta(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("app_id", "weeks", "horizon")) -> DataFrame:
    """Per horizon: median errors of two scorings of the same cells and of their difference."""
    j = a.select(*keys, F.col("abs_err").alias("ea"), F.col("signed_err").alias("sa")).join(
        b.select(*keys, F.col("abs_err").alias("eb"), F.col("signed_err").alias("sb")), [*keys])
    return j.groupBy("horizon").agg(
        F.median("ea").alias("first"), F.median("eb").alias("second"),
        F.median(F.col("eb") - F.col("ea")).alias("paired_delta"), F.count(F.lit(1)).alias("n")).withColumn(
        "degradation", F.col("second") - F.col("first"))


# ------------------------------------------------------------------ leave one cohort out (web)
def _visible_cells(mx: DataFrame, p: Params, weeks: Sequence[int], levers: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Ratio cells and combinations per application and number of visible weeks, from counts per age."""
    z = H.lever_columns(mx, p)
    first = [(lv, "billday_first" if lv == "billday_bin" else lv) for lv in p.levers]
    age = F.floor("weeks_obs").alias("age")
    cells = z.groupBy("app_id", age, "step_k", *[F.col(c).alias(lv) for lv, c in first]).agg(
        F.count(F.lit(1)).alias("n"), F.sum("died").alias("died"))
    cells = cells.withColumn("weeks", weeks_array(weeks)).where(
        (F.col("age") >= F.col("weeks")) & (F.col("step_k") + 1 <= F.col("weeks")))
    cells = cells.groupBy("app_id", "weeks", "step_k", *p.levers).agg(F.sum("n").alias("n"), F.sum("died").alias("died"))
    per = z.groupBy("app_id", "sub_id").agg(F.max("weeks_obs").alias("weeks_obs"), *[F.min_by(c, "step_k").alias(lv) for lv, c in first])
    mix = per.groupBy("app_id", age, *p.levers).agg(F.count(F.lit(1)).alias("w")).withColumn("weeks", weeks_array(weeks))
    mix = mix.where(F.col("age") >= F.col("weeks")).groupBy("app_id", "weeks", *p.levers).agg(F.sum("w").alias("w"))
    return cells, mix


def _curves(cells: DataFrame, mix: DataFrame, state: H.State, p: Params, levers, name: str) -> DataFrame:
    by = ["fold", "weeks"]
    hr = H.hazard_ratio(cells, state, p, by, None, ["fold"], levers)
    m = H.personal_multiplier(mix, state.mult, p, ["fold"], levers).join(hr.select(*by, "hr"), by, "left")
    m = m.withColumn("hr", F.coalesce("hr", F.lit(1.0)))
    c = H.mixture_curve(m, state.hazard, p, by, p.h_ext, ["fold"])
    return c.select(*by, "k", clip("s", 0.0, 1.0).alias(name))


def cohort_folds(web: V.Web, p: Params, donor: DataFrame, weeks: Sequence[int], offsets: Sequence[int],
                 min_subs: int = 100, min_mature: int = 30, levers: Sequence[str] | None = None) -> DataFrame:
    """Leave-one-cohort-out: pooled curve against the cohort's own curve, in survival and money. What
    is used more than once is written, so that no plan holds another step's plan several times."""
    mx, train = web.mx, L.training_rows(web.mx)
    folds = V.cut(S.payers(mx).where(F.col("payers") >= min_subs))
    state = loo_fit(train, p, folds, donor=donor, splice=True, levers=levers)
    state = H.State(state.hazard, V.cut(state.mult))
    cells, mix = (V.cut(x) for x in _visible_cells(mx, p, weeks, p.levers))
    own = folds.select("app_id")
    mix_own = mix.join(own, "app_id", "left_semi").withColumnRenamed("app_id", "fold")
    enough = mix_own.groupBy("fold", "weeks").agg(F.sum("w").alias("subs")).where(F.col("subs") >= min_subs // 2)
    cells_own = cells.join(own, "app_id", "left_semi").withColumnRenamed("app_id", "fold")
    v3 = V.cut(_curves(cells_own, mix_own, state, p, levers, "v3"))
    pc, pm = (V.cut(x) for x in _visible_cells(train, p, weeks, p.levers))
    v2 = V.cut(_curves(V.cut(without_own(pc, folds, ["n", "died"])), V.cut(without_own(pm, folds, ["w"])), state, p, levers, "v2"))
    act = S.direct_survival(mx, p, offset=p.return_periods).withColumnRenamed("app_id", "fold")
    act = act.where((F.col("mature") >= min_mature) & (F.col("fact") > 0)).select("fold", "k", F.col("mature").alias("n_mature"), F.col("fact").alias("actual"))
    t = enough.select("fold", "weeks").withColumn("horizon_offset", weeks_array(offsets)).withColumn("k", F.col("weeks") + F.col("horizon_offset"))
    t = t.join(act, ["fold", "k"]).join(v3, ["fold", "weeks", "k"], "left").join(v2, ["fold", "weeks", "k"], "left")
    # money on the same folds
    people = V.cut(web.pop.join(mx.select(F.col("sub_id").alias("session_id"), "app_id").distinct(), "session_id").withColumnRenamed("app_id", "fold"))
    pair = V.cut(ltv_pairs(web, people, p, weeks, offsets, min_mature))
    obs = V.cut(V.checkpoint_observations(web.events, web.pop, V.base_ladder(web.events, p), p))
    rate = V.attach_rates(obs, people.withColumn("has_base", F.lit(True)), p, ["fold"]).select("fold", "share_ups")
    share = people.groupBy("fold").agg(F.avg(F.col("has_base").cast("double")).alias("share_base"))
    both = v3.join(v2, ["fold", "weeks", "k"]).join(rate, "fold").join(share, "fold").where(F.col("k") > F.col("weeks"))
    w = Window.partitionBy("fold", "weeks").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    inc = both.select("fold", "weeks", "k", *[
        F.sum(V.expected_payment(p, F.col("share_base"), F.col("share_ups"), "k", v)).over(w).alias(f"i{v}") for v in ("v2", "v3")])
    t = t.join(pair, ["fold", "weeks", "k"], "left").join(inc, ["fold", "weeks", "k"], "left")
    for v in ("v2", "v3"):
        t = t.withColumn(f"ltv_{v}", F.col("ltv_anchor") + F.col(f"i{v}"))
        t = t.withColumn(f"err_{v}", (F.col(v) - F.col("actual")) / F.col("actual"))
        t = t.withColumn(f"ltv_err_{v}", F.try_divide(F.col(f"ltv_{v}") - F.col("ltv_actual"), "ltv_actual"))
    return t.drop("iv2", "iv3")


def ltv_pairs(web: V.Web, people: DataFrame, p: Params, weeks: Sequence[int], offsets: Sequence[int], min_mature: int) -> DataFrame:
    """Mean observed value at the anchor and at the horizon over one set of people: those old enough
    for the horizon. Sums per (fold, age, week) are compared, never people."""
    n = people.groupBy("fold", "age_weeks_now").agg(F.count(F.lit(1)).alias("n"))
    net = R.weekly_net(web.events, people, p, ["fold", "age_weeks_now"]).select("fold", "age_weeks_now", "week", "net")
    pairs = F.explode(F.array(*[F.struct(F.lit(int(a)).cast("bigint").alias("weeks"), F.lit(int(a + o)).cast("bigint").alias("k"))
                                for a in weeks for o in offsets]))
    old = F.col("age_weeks_now") >= F.col("k") + F.lit(p.return_periods)

    def spread(df):
        return df.withColumn("_p", pairs).select(*df.columns, "_p.weeks", "_p.k").where(old)

    cnt = spread(n).groupBy("fold", "weeks", "k").agg(F.sum("n").alias("n"))
    mon = spread(net).groupBy("fold", "weeks", "k").agg(
        F.sum(F.when(F.col("week") <= F.col("weeks"), F.col("net")).otherwise(0.0)).alias("a"),
        F.sum(F.when(F.col("week") <= F.col("k"), F.col("net")).otherwise(0.0)).alias("t"))
    j = cnt.where(F.col("n") >= min_mature).join(mon, ["fold", "weeks", "k"], "left").withColumn("_m", web.max_week)
    j = j.where(F.col("k") <= F.col("_m"))
    return j.select("fold", "weeks", "k", (F.coalesce("a", F.lit(0.0)) / F.col("n")).alias("ltv_anchor"),
                    (F.coalesce("t", F.lit(0.0)) / F.col("n")).alias("ltv_actual")).where("ltv_actual > 0")


def fold_summary(detail: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median absolute and signed errors of both forms, survival and money."""
    aggs = []
    for c in ("err_v2", "err_v3", "ltv_err_v2", "ltv_err_v3"):
        aggs += [F.median(F.abs(c)).alias(f"{c}_abs"), F.median(c).alias(f"{c}_sign")]
    return detail.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ calendar test
def calendar_inventory(mx: DataFrame, cutoffs: Sequence[str], p: Params, young_from: int = 8, young_to: int = 1) -> DataFrame:
    """Per cut-off and application: was it young then, and can it be scored on the full data?"""
    first = mx.groupBy("app_id").agg(F.min("pay_ts").alias("first_pay"))
    f12 = S.direct_survival(mx, p).where(F.col("k") == p.horizons[0]).select("app_id", "mature")
    crash = S.crash_flags(mx, p).select("app_id", "crash")
    t = F.explode(F.array(*[F.lit(c).cast("timestamp") for c in cutoffs]))
    a = first.join(f12, "app_id", "left").join(crash, "app_id", "left").withColumn("t", t)
    age = periods_between("first_pay", "t", p.period_days)
    a = a.withColumn("young", (age >= young_to) & (age <= young_from))
    a = a.withColumn("with_fact", F.col("young") & (F.coalesce("mature", F.lit(0)) >= p.min_mature))
    return a.withColumn("evaluable", F.col("with_fact") & ~F.coalesce("crash", F.lit(False)))


def inventory_counts(inventory: DataFrame, mx: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """Candidates per cut-off and rows to train on (rows are counted per day first)."""
    c = inventory.groupBy("t").agg(F.count_if("young").alias("young_candidates"), F.count_if("with_fact").alias("with_fact"),
                                   F.count_if("evaluable").alias("evaluable"))
    days = mx.groupBy(F.to_date("pay_ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    t = F.explode(F.array(*[F.lit(x).cast("timestamp") for x in cutoffs]))
    rows = days.withColumn("t", t).where(F.col("day") < F.to_date("t")).groupBy("t").agg(F.sum("n").alias("train_rows"))
    return c.join(rows, "t", "left")


def calendar_state(cube: DataFrame, points: Sequence[Column], p: Params) -> H.State:
    """Hazard and multipliers per cut-off `t` from what was known then, crashed applications left out of the multipliers."""
    app = ["t", "app_id"]
    rates = VW.at_points(cube, points, "t", ["app_id", "step_k"], ["n", "surv"], "old")
    h = V.cut(H.hazard_from_rates(rates.where((F.col("n") >= p.min_risk) & (F.col("step_k") <= p.hmax)), ["t"]))
    # of the keys old enough for step k: those that have step k - 1, and those that have step k
    risk = VW.at_points(cube.where(F.col("step_k") < p.hmax), points, "t", ["app_id", "step_k"], ["n"], "older")
    risk = risk.select(*app, (F.col("step_k") + 1).alias("step_k"), F.col("n").alias("at_risk")).where(F.col("at_risk") >= p.crash_min_risk)
    worst = risk.join(rates.select(*app, "step_k", F.col("n").alias("kept")), [*app, "step_k"], "left").groupBy(*app).agg(
        F.min(F.coalesce("kept", F.lit(0)) / F.col("at_risk")).alias("worst"))
    payers = VW.at_points(cube.where("step_k = 1"), points, "t", ["app_id"], ["n"], "seen").where(F.col("n") >= p.min_payers)
    crash = worst.where(F.col("worst") < p.crash_floor).join(payers, app, "left_semi")
    cells = VW.at_points(cube.where(F.col("step_k") <= p.clean_step_max), points, "t", ["app_id", *p.levers, "step_k"], ["n", "died"], "old")
    cells = cells.join(crash, app, "left_anti").groupBy("t", *p.levers, "step_k").agg(F.sum("n").alias("n"), F.sum("died").alias("died"))
    return H.State(h, V.cut(H.residual_multipliers(cells, h, p, ["t"])))


def known_cells(cube: DataFrame, points: Sequence[Column], p: Params, by: Sequence[str], ages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ratio cells and combinations (w) per group and cut-off `t`, as known then. `ages`: by, t and `weeks`, the steps that count."""
    first = cube.select(*by, "step_k", *VW.first_levers(p), "seen", "older", "n", "died")
    cells = VW.at_points(first, points, "t", [*by, "step_k", *p.levers], ["n", "died"], "older")
    cells = cells.join(ages, [*by, "t"]).where(F.col("step_k") <= F.col("weeks"))
    mix = VW.at_points(first.where("step_k = 1"), points, "t", [*by, *p.levers], ["n"], "seen").withColumnRenamed("n", "w")
    return cells, mix.join(ages, [*by, "t"], "left_semi")


def calendar_backtest(mx: DataFrame, cutoffs: Sequence[str], p: Params, max_weeks: int = 8) -> DataFrame:
    """Train on what was known at each cut-off, predict the applications young then, and score on the full data. The matrix is counted
    once for all cut-offs."""
    by, points = ["t", "app_id"], [F.lit(c).cast("timestamp") for c in sorted(cutoffs)]
    inv = calendar_inventory(mx, cutoffs, p, max_weeks, 1).where("evaluable")
    ages = V.cut(inv.select(*by, F.least(F.floor(whole_days("first_pay", "t") / F.lit(float(p.period_days))), F.lit(max_weeks)).cast("bigint").alias("weeks")))
    cube = V.cut(VW.calendar_cube(mx, points, p, ["app_id"]))
    state = calendar_state(cube, points, p)
    h = state.hazard
    mine = cube.join(ages.select("app_id").distinct(), "app_id", "left_semi")
    rc, mix = known_cells(mine, points, p, ["app_id"], ages)
    hr = H.hazard_ratio(rc, state, p, by, None, ["t"])
    mix = H.personal_multiplier(mix, state.mult, p, ["t"]).join(hr.select(*by, "hr"), by, "left")
    mp = H.mixture_curve(mix.withColumn("hr", F.coalesce("hr", F.lit(1.0))), h, p, by, state_by=["t"]).withColumn("model", F.lit("map"))
    step = [*by, "step_k"]
    e = VW.at_points(mine, points, "t", ["app_id", "step_k"], ["n"], "seen").withColumnRenamed("n", "na").join(
        VW.at_points(mine, points, "t", ["app_id", "step_k"], ["n", "died"], "old").withColumnRenamed("died", "d"), step, "left")
    e = e.join(ages, by).where(F.col("step_k") <= F.col("weeks")).join(h.select("t", "step_k", "h"), ["t", "step_k"], "left")
    use = (F.col("n") >= p.hr_min_n) & (F.col("h") > 0)
    lg = F.ln(clip(F.try_divide(F.try_divide("d", "n"), "h"), *p.oe_clip))
    er = e.groupBy(*by).agg(F.sum("na").alias("ns"), F.try_divide(F.sum(F.when(use, F.col("n") * lg)), F.sum(F.when(use, F.col("n")))).alias("l"))
    er = er.select(*by, F.exp(F.coalesce("l", F.lit(0.0)) * F.col("ns") / (F.col("ns") + F.lit(p.k_shrink))).alias("hr"), F.lit(1.0).alias("mult"), F.lit(1).cast("bigint").alias("w"))
    em = H.mixture_curve(er, h, p, by, state_by=["t"], gap="zero").withColumn("model", F.lit("empirical"))
    fact = S.direct_survival(mx, p).where("fact > 0").select("app_id", "k", "fact")
    out = mp.unionByName(em).where(F.col("k").isin(*p.horizons)).join(fact, ["app_id", "k"])
    return out.withColumnRenamed("k", "horizon").withColumn("signed_err", (F.col("s") - F.col("fact")) / F.col("fact")).withColumn("abs_err", F.abs("signed_err"))


# ------------------------------------------------------------------ segments inside applications
def segments(mx: DataFrame, state: H.State, apps: DataFrame, p: Params, weeks: int) -> DataFrame:
    """Per application and (collapsed) geo: prediction with the application's ratio, the plain
    empirical one, facts of both levels, and the geo multiplier."""
    rows = mx.join(apps.where("not crash").select("app_id"), "app_id")
    geo = state.mult.where("lever = 'geo'").select(F.col("raw").alias("geo"), F.col("cat").alias("segment"), F.col("mult").alias("m_geo"))
    rows = rows.withColumn("geo", F.coalesce(F.nullif(F.col("geo"), F.lit("")), F.lit("(none)")))
    rows = rows.join(geo, "geo", "left").withColumn("segment", F.coalesce("segment", "geo")).withColumn("m_geo", F.coalesce("m_geo", F.lit(1.0)))
    rows = V.cut(rows)
    hr = H.hazard_ratio(H.ratio_cells(rows, p, ["app_id"]), state, p, ["app_id"], [weeks]).select("app_id", "hr")
    by = ["app_id", "segment"]
    mix = H.personal_multiplier(H.combos(rows, p, by), state.mult, p).join(hr, "app_id")
    seg = H.mixture_curve(mix, state.hazard, p, by).withColumnRenamed("s", "map")
    size = rows.groupBy(*by).agg(F.count_distinct("sub_id").alias("n_subs"), F.first("m_geo").alias("m_geo"))
    app = H.mixture_curve(mix, state.hazard, p, ["app_id"]).withColumnRenamed("s", "app_map")
    emp = H.empirical_predict(rows, p, ["app_id"], [weeks]).select("app_id", "k", F.col("s").alias("emp"))
    fact = S.direct_survival(rows, p, by).select(*by, "k", "fact", "mature")
    app_fact = S.direct_survival(rows, p).select("app_id", "k", F.col("fact").alias("app_fact"))
    return (seg.join(size, by).join(fact, [*by, "k"], "left").join(app, ["app_id", "k"]).join(emp, ["app_id", "k"])
            .join(app_fact, ["app_id", "k"], "left").where(F.col("k").isin(*p.horizons)))


def segment_scores(seg: DataFrame, min_subs: int, min_mature: int, bet: float = 0.05) -> DataFrame:
    """Errors, share of wins and direction test per horizon."""
    s = seg.where((F.col("n_subs") >= min_subs) & (F.col("mature") >= min_mature) & (F.col("fact") > 0))
    em, ee = F.abs(F.col("map") - F.col("fact")), F.abs(F.col("emp") - F.col("fact"))
    sf, sp = F.signum(F.col("fact") - F.col("app_fact")), F.signum(F.col("map") - F.col("app_map"))
    test = (sf != 0) & (sp != 0)
    bold = test & (F.abs(F.col("m_geo") - 1) > bet)
    return s.groupBy(F.col("k").alias("horizon")).agg(
        F.count(F.lit(1)).alias("n"), F.median(em / F.col("fact")).alias("map_err"), F.median(ee / F.col("fact")).alias("emp_err"),
        F.count_if(em < ee).alias("wins"), F.count_if(test).alias("tests"), F.count_if(test & (sf == sp)).alias("hits"),
        F.count_if(bold).alias("bets"), F.count_if(bold & (sf == sp)).alias("bet_hits"))


def reconstruction(seg: DataFrame) -> DataFrame:
    """Do the segment curves, weighted by size, rebuild the application's curve?"""
    g = seg.groupBy("app_id", "k").agg((F.sum(F.col("map") * F.col("n_subs")) / F.sum("n_subs")).alias("r"), F.first("app_map").alias("a"))
    return g.groupBy("k").agg(F.max(F.abs(F.col("r") - F.col("a"))).alias("worst")).withColumn("ok", F.col("worst") <= 0.02)


# ------------------------------------------------------------------ drift, profiles, diagnostics
def portfolio_table(mx: DataFrame, p: Params, now: Column) -> DataFrame:
    """Launch and mature facts of each application at the three horizons."""
    a, b, c = p.horizons
    f = S.direct_survival(mx, p).where(F.col("k").isin(a, b, c) & (F.col("mature") >= p.min_mature))
    w = f.groupBy("app_id").agg(*[F.max(F.when(F.col("k") == h, F.col("fact"))).alias(f"fact_{i}") for i, h in enumerate((a, b, c))])
    l = mx.groupBy("app_id").agg(F.min("pay_ts").alias("launch")).withColumn("age", periods_between(F.col("launch"), now, p.period_days))
    return l.join(w, "app_id", "left").withColumn("matured", F.col("fact_2").isNotNull()).withColumn(
        "old_not_matured", (F.col("age") >= c) & F.col("fact_2").isNull())


def launch_trend(table: DataFrame, fact: str = "fact_1", month_days: float = 30.44) -> DataFrame:
    """Slope and correlation of the fact (in points) against months since the first launch."""
    t = table.where(F.col(fact).isNotNull())
    first = F.min("launch").over(Window.partitionBy(F.lit(0)))
    m = t.withColumn("m", (F.unix_micros("launch") - F.unix_micros(first)) / F.lit(86_400e6 * month_days))
    y = F.col(fact) * 100
    return m.agg(F.regr_slope(y, F.col("m")).alias("slope"), F.regr_intercept(y, F.col("m")).alias("intercept"),
                 F.corr(F.col("m"), y).alias("r"), F.count(F.lit(1)).alias("n"))


def matured_split(table: DataFrame, fact: str = "fact_1") -> DataFrame:
    g = F.when(F.col("matured"), "matured").when(F.col("old_not_matured"), "old_not_matured").otherwise("young")
    return table.groupBy(g.alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.count(fact).alias("with_fact"), F.avg(fact).alias("mean_fact"))


def error_profile(facts: DataFrame, survival: DataFrame, by: str = "cohort") -> DataFrame:
    """Model value against payer value per cohort and rebill: ARPU of the cohort times the curve.

    survival: cohort, k, s."""
    w = Window.partitionBy(by).orderBy("rebill_number")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    f = facts.withColumn("_a", F.last("arpu_at_payment", True).over(upto))
    j = f.join(survival.select(by, F.col("k").alias("rebill_number"), "s"), [by, "rebill_number"], "left")
    step = F.when(F.col("rebill_number") == 0, F.col("_a")).otherwise(F.coalesce(F.col("s") * F.col("_a"), F.lit(0.0)))
    m = j.withColumn("model_ltv", F.sum(step).over(upto))
    return m.select(by, "rebill_number", "payer_ltv", "model_ltv", "s", "rebill_percent",
                    (F.try_divide(F.col("model_ltv") - F.col("payer_ltv"), "payer_ltv") * 100).alias("signed_err"),
                    (F.try_divide(F.col("s") - F.col("rebill_percent"), "rebill_percent") * 100).alias("surv_err"))


def error_stability(profile: DataFrame, err: str = "signed_err") -> DataFrame:
    return profile.groupBy("rebill_number").agg(
        F.count(err).alias("n"), F.avg(err).alias("mean"), F.stddev(err).alias("std"), F.min(err).alias("min"), F.max(err).alias("max"))


def residual_slope(stability: DataFrame, k_max: int) -> DataFrame:
    """Mean residual and its slope inside and outside the reliable zone."""
    z = F.when(F.col("rebill_number") <= k_max, "reliable").otherwise("tail")
    x = F.col("rebill_number").cast("double")
    return stability.where("rebill_number >= 1").groupBy(z.alias("zone")).agg(
        F.avg("mean").alias("mean_residual"), F.regr_slope(F.col("mean"), x).alias("slope"), F.count(F.lit(1)).alias("n"))


def correction_folds(facts: DataFrame, ref: DataFrame, hmax: int, min_n: int = 40) -> DataFrame:
    """Correction fitted without each cohort in turn, scored on that cohort's survival."""
    names = facts.select("cohort").distinct().agg(F.collect_set("cohort")).scalar()
    others = facts.withColumn("fold", F.explode(names)).where("fold <> cohort")
    fit = C.log_linear_fit(C.pooled_hazard(others, ["fold"]), ref, min_n, ["fold"])
    h = C.corrected_hazard(ref, C.correction(fit, hmax, by=["fold"]), ["fold"])
    s = C.survival_of(h, ["fold"]).select(F.col("fold").alias("cohort"), F.col("k").alias("rebill_number"), "s")
    j = facts.where("rebill_number >= 1 and rebill_percent > 0").join(s, ["cohort", "rebill_number"])
    e = (F.col("s") - F.col("rebill_percent")) / F.col("rebill_percent") * 100
    return j.groupBy("cohort").agg(F.avg(e).alias("mean_signed"), F.avg(F.abs(e)).alias("mean_abs"), F.count(F.lit(1)).alias("n"))


def top_share(rows: DataFrame, by: str, c: str) -> DataFrame:
    """Share of the most frequent value per group (smallest value on ties)."""
    g = rows.groupBy(by, c).agg(F.count(F.lit(1)).alias("n"))
    top = F.min_by(c, F.struct(-F.col("n"), F.col(c)))
    return g.groupBy(by).agg(top.alias(f"top_{c}"), (F.max("n") / F.sum("n")).alias(f"top_{c}_share"))


def value_share(rows: DataFrame, by: str, cond: Column, name: str) -> DataFrame:
    return rows.groupBy(by).agg(F.avg(cond.cast("double")).alias(name))


def ratio_sensitivity(mx: DataFrame, state: H.State, p: Params, horizon: int, facts: DataFrame) -> DataFrame:
    """How ratio and forecast move from one to two visible weeks, with the parts that move them."""
    cells = V.cut(H.personal_multiplier(H.ratio_cells(mx, p, ["app_id"]), state.mult, p))
    hr = H.hazard_ratio(cells.drop("mult"), state, p, ["app_id"], [1, 2])
    e = cells.join(state.hazard.select("step_k", "h"), "step_k").withColumn("_x", clip(F.col("h") * F.col("mult"), *p.hazard_clip))
    oe = e.where("step_k <= 2").groupBy("app_id", "step_k").agg(
        (F.sum("died") / F.sum("n")).alias("o"), (F.sum(F.col("n") * F.col("_x")) / F.sum("n")).alias("x"))
    oe = oe.groupBy("app_id").agg(*[F.max(F.when(F.col("step_k") == k, F.col("o") / F.col("x"))).alias(f"ratio_step{k}") for k in (1, 2)])
    mix = H.personal_multiplier(H.combos(mx, p, ["app_id"]), state.mult, p)
    mean = mix.groupBy("app_id").agg((F.sum(F.col("mult") * F.col("w")) / F.sum("w")).alias("personal_mult"))
    pred = H.mixture_curve(mix.join(hr, "app_id"), state.hazard, p, ["app_id", "weeks"]).where(F.col("k") == horizon)
    w = pred.join(hr, ["app_id", "weeks"]).withColumn("shrink", F.col("n_seen") / (F.col("n_seen") + F.lit(p.k_shrink)))
    wide = w.groupBy("app_id").agg(*[F.max(F.when(F.col("weeks") == k, F.col(c))).alias(f"{c}_{k}") for k in (1, 2) for c in ("s", "hr", "n_seen", "shrink")])
    f = facts.where((F.col("k") == horizon) & ~F.col("crash") & (F.col("mature") >= p.min_mature) & (F.col("fact") > 0)).select("app_id", "fact")
    out = wide.join(f, "app_id").join(oe, "app_id", "left").join(mean, "app_id")
    for k in (1, 2):
        out = out.withColumn(f"signed_{k}", (F.col(f"s_{k}") - F.col("fact")) / F.col("fact") * 100)
    return out


def multiplier_report(mult: DataFrame) -> DataFrame:
    """Categories with their share of rows and what the multiplier means."""
    c = H.multiplier_categories(mult).where("mult is not null")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lever"))
    sense = F.when(F.col("mult") > 1.05, "higher risk").when(F.col("mult") < 0.95, "lower risk").otherwise("neutral")
    return c.withColumn("share", share).withColumn("meaning", sense)


def frozen_backtest(mx: DataFrame, state: H.State, cutoffs: Sequence[str], p: Params, by: Sequence[str], max_weeks: int = 8,
                    state_by: Sequence[str] = ()) -> DataFrame:
    """Every group of keys (`by`, constant per key, such as its entry period) as known at every cut-off `t`, predicted by a foreign
    state. `state` may have key columns `state_by` among `by` and t."""
    points = [F.lit(c).cast("timestamp") for c in sorted(cutoffs)]
    key = [*by, "t"]
    begin = mx.groupBy(*by).agg(F.min("pay_ts").alias("_b")).withColumn("t", F.explode(F.array(*points))).where("_b < t")
    weeks = F.greatest(F.lit(1), F.least(F.lit(max_weeks), F.floor(whole_days("_b", "t") / F.lit(float(p.period_days)))))
    ages = V.cut(begin.select(*key, weeks.cast("bigint").alias("weeks")))
    cells, mix = known_cells(V.cut(VW.calendar_cube(mx, points, p, by)), points, p, by, ages)
    hr = H.hazard_ratio(cells, state, p, key, None, state_by)
    mix = H.personal_multiplier(mix, state.mult, p, state_by).join(hr.select(*key, "hr"), key, "left")
    c = H.mixture_curve(mix.withColumn("hr", F.coalesce("hr", F.lit(1.0))), state.hazard, p, key, state_by=state_by)
    f = S.direct_survival(mx, p, by).select(*by, "k", "fact", "mature")
    out = c.where(F.col("k").isin(*p.horizons)).join(f, [*by, "k"], "left")
    err = F.when(F.col("fact") > 0, (F.col("s") - F.col("fact")) / F.nullif(F.col("fact"), F.lit(0.0)) * 100)
    return out.select(*key, F.col("k").alias("horizon"), "fact", F.col("s").alias("predicted"), F.coalesce("mature", F.lit(0)).cast("bigint").alias("n_mature"), err.alias("signed_err"))


def vintage_facts(mx: DataFrame, amounts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group and rebill: share of its keys that paid it, mean amount, and value per key up to it. amounts: sub_id, tie, amount."""
    per = mx.select(*by, "sub_id", "tie", "step_k").join(amounts, ["sub_id", "tie"]).groupBy(*by, (F.col("step_k") - 1).alias("rebill_number")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("amount").alias("_rev"))
    w = Window.partitionBy(*by).orderBy("rebill_number")
    n0 = F.first("_n").over(w)
    return per.select(*by, "rebill_number", (F.col("_n") / n0).alias("rebill_percent"), (F.col("_rev") / F.col("_n")).alias("arpu_at_payment"),
                      (F.sum("_rev").over(w) / n0).alias("payer_ltv"))


def vintage_forecasts(mx: DataFrame, state: H.State, facts: DataFrame, p: Params, weeks: Sequence[int], by: Sequence[str]) -> DataFrame:
    """Forecast of every cohort (`by`, constant per key) from each number of visible periods, next to the facts: raw value,
    value scaled to the fact at the anchor, and the error of survival up to the anchor.

    facts: by, rebill_number, rebill_percent, arpu_at_payment, payer_ltv."""
    weeks = sorted(weeks)
    points, key = [F.lit(int(w)).cast("bigint") for w in weeks], [*by, "weeks"]
    cube = V.cut(VW.visible_cube(mx, weeks, p, by))
    cube = cube.select(*by, "step_k", *VW.first_levers(p), "seen", "gone", "n", "died")
    cells = V.cut(VW.at_points(cube, points, "weeks", [*by, "step_k", *p.levers], ["n", "died"], "seen", "gone"))
    mix = V.cut(VW.at_points(cube.where("step_k = 1"), points, "weeks", [*by, *p.levers], ["n"], "seen", "gone").withColumnRenamed("n", "w"))
    size = mix.groupBy(*key).agg(F.sum("w").alias("visible_subs")).join(cells.groupBy(*key).agg(F.sum("n").alias("visible_rows")), key)
    hr = H.hazard_ratio(cells.where(F.col("step_k") + 1 <= F.col("weeks")), state, p, key)
    mix = H.personal_multiplier(mix, state.mult, p).join(hr.select(*key, "hr"), key, "left")
    c = H.mixture_curve(mix.withColumn("hr", F.coalesce("hr", F.lit(1.0))), state.hazard, p, key)
    a = facts.select(*by, F.col("rebill_number").alias("k"), "arpu_at_payment", "rebill_percent", "payer_ltv")
    g = size.select(*key).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(p.hmax).cast("bigint"))))
    g = g.join(c, [*key, "k"], "left").join(a, [*by, "k"], "left")
    o = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("_a", F.last("arpu_at_payment", True).over(o))
    step = F.when(F.col("k") == 0, F.col("_a")).otherwise(F.coalesce(F.col("s") * F.col("_a"), F.lit(0.0)))
    g = g.withColumn("raw", F.sum(step).over(o))
    inside = (F.col("k") >= 1) & (F.col("k") <= F.col("weeks"))
    out = g.groupBy(*key).agg(
        F.max(F.when(F.col("k") == F.col("weeks"), F.col("payer_ltv"))).alias("anchor_fact"),
        F.max(F.when(F.col("k") == F.col("weeks"), F.col("raw"))).alias("anchor_raw"),
        F.max(F.when(F.col("k") == p.hmax, F.col("raw"))).alias("raw_end"),
        F.avg(F.when(inside, F.abs(F.col("s") - F.col("rebill_percent")))).alias("survival_mae"))
    scale = F.when(F.col("anchor_raw") > 0, F.col("anchor_fact") / F.nullif(F.col("anchor_raw"), F.lit(0.0)))
    return out.join(size, key).withColumn("scale", scale).withColumn("anchored_end", F.col("raw_end") * F.col("scale"))


def walk_forward(web: V.Web, state: H.State, p: Params, dims: Sequence[str], weeks: Sequence[int], horizons: Sequence[int]) -> DataFrame:
    """Per cell: the value at fixed horizons as forecast from each number of visible weeks, and the
    fact. `state` has a fold column holding the cohort left out.

    People are counted by the number of visible weeks they are old enough for, money by cell and week is summed up to every week that is
    asked for, in one row per cell; weeks and horizons given twice count once."""
    pop = web.pop
    weeks, horizons = sorted({int(w) for w in weeks}), sorted({int(h) for h in horizons})
    cells, mix = _visible_cells(web.mx, p, weeks, p.levers)
    hr = H.hazard_ratio(cells.withColumnRenamed("app_id", "fold"), state, p, ["fold", "weeks"], None, ["fold"]).select("fold", "weeks", "hr")
    people = pop.where("has_base").select(F.col("session_id").alias("sub_id"), *dims)
    first = [(lv, "billday_first" if lv == "billday_bin" else lv) for lv in p.levers]
    per = H.lever_columns(web.mx, p).groupBy("sub_id", "app_id").agg(F.max("weeks_obs").alias("weeks_obs"), *[F.min_by(c, "step_k").alias(f"l_{lv}") for lv, c in first])
    points = [F.lit(w).cast("bigint") for w in weeks]
    group = ["fold", *[f"d_{c}" for c in dims], *p.levers]
    m = per.where(F.col("weeks_obs").isNotNull()).join(people, "sub_id").select(
        F.col("app_id").alias("fold"), *[F.col(c).alias(f"d_{c}") for c in dims], *[F.col(f"l_{lv}").alias(lv) for lv in p.levers],
        F.lit(0).alias("_from"), VW.first_point(points, lambda w: F.col("weeks_obs") < w).alias("_gone"), F.lit(1).alias("w"))
    m = VW.in_force(m, points, "weeks", group, ["w"], "_from", "_gone")
    m = H.personal_multiplier(m, state.mult, p, ["fold"]).join(hr, ["fold", "weeks"], "left").withColumn("hr", F.coalesce("hr", F.lit(1.0)))
    by = ["fold", *[f"d_{c}" for c in dims], "weeks"]
    c = H.mixture_curve(m, state.hazard, p, by, p.h_ext, ["fold"])
    c = c.select(*[F.col(f"d_{x}").alias(x) for x in dims], "weeks", "k", clip("s", 0.0, 1.0).alias("s"))
    ladder = V.base_ladder(web.events, p)
    rate = V.attach_rates(V.checkpoint_observations(web.events, pop, ladder, p), pop, p, dims).select(*dims, "share_ups")
    size = pop.groupBy(*dims).agg(F.count_if("has_base").alias("n"), F.floor(F.avg("age_weeks_now")).alias("age")).withColumn("max_week", web.max_week)
    net = R.weekly_net(web.events, pop.where("has_base"), p, [*dims]).withColumn("max_week", web.max_week)
    asked = sorted({*weeks, *horizons})
    zero, week = F.lit(0.0), F.col("week")
    money = net.groupBy(*dims).agg(*[F.sum(F.when(week <= F.least(F.lit(x), "max_week"), F.col("net")).otherwise(zero)).alias(f"_to_{x}") for x in asked])
    pay, k = V.expected_payment(p, F.lit(1.0), F.col("share_ups")), F.col("k")
    inc = c.join(rate, [*dims], "left").groupBy(*dims, "weeks").agg(
        *[F.sum(F.when((k > F.col("weeks")) & (k <= h), pay)).alias(f"_inc_{h}") for h in horizons])
    upto = F.create_map(*[x for w in asked for x in (F.lit(w).cast("bigint"), F.coalesce(f"_to_{w}", zero))])
    per_horizon = [F.struct(F.lit(h).cast("bigint").alias("horizon"), upto[F.least("weeks", F.lit(h).cast("bigint"))].alias("seen"),
                            F.coalesce(f"_to_{h}", zero).alias("all"), F.coalesce(f"_inc_{h}", zero).alias("inc")) for h in horizons]
    out = inc.join(size, [*dims]).where(F.col("weeks") <= F.col("age")).join(money, [*dims], "left")
    out = out.select(*dims, "weeks", "n", "age", "max_week", F.explode(F.array(*per_horizon)).alias("_e")).select("*", "_e.*")
    value = F.col("seen") / F.col("n") + F.col("inc")
    fact = F.when((F.col("horizon") <= F.col("age")) & (F.col("horizon") <= F.col("max_week")), F.col("all") / F.col("n"))
    return out.select(*dims, "weeks", "horizon", "n", value.alias("ltv"), fact.alias("fact"))
