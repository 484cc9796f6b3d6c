"""From survival to money: upsell attach rates, anchored projections, cell tables, weekly curves."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.functions.exprs import clip, period_of_life
from tenurekit.functions.ordered import cut
from tenurekit.operators import hazard as H
from tenurekit.operators import ladder as L
from tenurekit.operators import population as N
from tenurekit.operators import revenue as R
from tenurekit.operators import views as VW
from tenurekit.params import Params


@dataclass
class Web:
    """Prepared inputs of one web snapshot. Each table is written once and read by every step."""

    events: DataFrame
    pop: DataFrame
    mx: DataFrame
    max_week: Column


def prepare(raw: DataFrame, p: Params, grain: str = "person", cohort_unit: str = "week") -> Web:
    events = cut(R.load_events(raw, p, grain))
    pop = cut(N.attach_revenue(N.build_population(events, p, cohort_unit=cohort_unit), R.revenue_by_key(events, p)))
    mx = cut(L.web_matrix(events, pop, p))
    return Web(events, pop, mx, pop.agg(F.max("age_weeks_now")).scalar())


# ------------------------------------------------------------------ weekly facts
def in_population(df: DataFrame, pop: DataFrame, p: Params, cols: Sequence[str] = ()) -> DataFrame:
    """Rows of population members with their period of life."""
    return df.join(pop.select("session_id", "first_date", *cols), "session_id").withColumn(
        "week", period_of_life("first_date", "ts", p.period_days))


def base_ladder(events: DataFrame, p: Params) -> DataFrame:
    pays = events.withColumn("kind", L.web_kind(p)).where("kind = 'pay'").select("session_id", "ts", "tie")
    return L.payment_ladder(pays, p, "session_id")


def weekly_payers(payments: DataFrame, pop: DataFrame, p: Params, dims: Sequence[str]) -> DataFrame:
    """People (not payments) who paid in each week of life, per cell."""
    d = in_population(payments.select("session_id", "ts"), pop, p, dims).where(F.col("week") <= p.h_ext)
    return d.select(*dims, "session_id", "week").distinct().groupBy(*dims, "week").agg(F.count(F.lit(1)).alias("payers"))


# ------------------------------------------------------------------ upsell attach
def checkpoint_observations(events: DataFrame, pop: DataFrame, ladder: DataFrame, p: Params,
                            max_checkpoint: int | None = None) -> DataFrame:
    """(key, checkpoint week) where the key paid the base plan that week and the week has settled,
    with paid_ups 0/1. Checkpoints go to the end of the curve unless a last one is given."""
    settle = math.ceil(p.return_periods)
    at = F.col("week")
    on_grid = (at >= p.ups_first) & (at <= (p.h_ext if max_checkpoint is None else max_checkpoint)) & ((at - p.ups_first) % p.ups_every == 0)
    alive = (in_population(ladder.select("session_id", "ts"), pop, p, ["age_weeks_now"])
             .where(on_grid & (F.col("age_weeks_now") >= at + settle)).select("session_id", "week").distinct())
    ups = (in_population(events.where(F.col("event_type") == R.UPSELL).select("session_id", "ts"), pop, p)
           .where(on_grid).select("session_id", "week").distinct().withColumn("paid_ups", F.lit(1).cast("bigint")))
    return alive.join(ups, ["session_id", "week"], "left").withColumn("paid_ups", F.coalesce("paid_ups", F.lit(0).cast("bigint")))


def attach_rates(obs: DataFrame, pop: DataFrame, p: Params, dims: Sequence[str]) -> DataFrame:
    """Attach rate of each cell's base payers, pulled towards the portfolio rate when thin."""
    prior = F.coalesce(obs.agg(F.avg(F.col("paid_ups").cast("double"))).scalar(), F.lit(0.0))
    base = pop.where("has_base")
    seen = obs.join(base.select("session_id", *dims), "session_id").groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum("paid_ups").alias("n_paid"))
    cells = base.select(*dims).distinct().join(seen, [*dims], "left").fillna(0, ["n_obs", "n_paid"])
    rate = (F.col("n_paid") + F.lit(p.attach_shrink) * prior) / (F.col("n_obs") + F.lit(p.attach_shrink))
    return cells.withColumn("share_ups", rate)


# ------------------------------------------------------------------ model per cell
def cohort_ratios(train: DataFrame, state: H.State, p: Params) -> DataFrame:
    """One ratio per cohort, fitted on the whole cohort and never per cell."""
    return H.hazard_ratio(H.ratio_cells(train, p, ["app_id"]), state, p, ["app_id"])


def cell_curves(mx: DataFrame, pop: DataFrame, state: H.State, ratios: DataFrame, p: Params,
                dims: Sequence[str]) -> DataFrame:
    """Survival per cell: the lever mix of its base payers times the ratio of its cohort (first dim)."""
    people = pop.where("has_base").select(F.col("session_id").alias("sub_id"), *[F.col(c).alias(f"_d_{c}") for c in dims])
    by = [f"_d_{c}" for c in dims]
    mix = H.personal_multiplier(H.combos(mx.join(people, "sub_id"), p, by), state.mult, p)
    mix = mix.join(ratios.select(F.col("app_id").alias("_a"), "hr"), F.col(by[0]).cast("string") == F.col("_a"), "left")
    mix = mix.withColumn("hr", F.coalesce("hr", F.lit(1.0)))
    c = H.mixture_curve(mix, state.hazard, p, by, p.h_ext)
    return c.select(*[F.col(b).alias(d) for b, d in zip(by, dims)], "k", clip("s", 0.0, 1.0).alias("s"))


def is_checkpoint(k: str, p: Params) -> Column:
    return (F.col(k) >= p.ups_first) & ((F.col(k) - p.ups_first) % p.ups_every == 0)


def expected_payment(p: Params, share_base, share_ups, k: str = "k", s: str = "s") -> Column:
    """Expected money of period k: the plan price times survival, plus the upsell at checkpoints.
    Survival is counted from entry, because the anchor is a mean over everybody."""
    ups = F.when(is_checkpoint(k, p), share_ups * F.lit(p.net_ups_price) * F.col(s)).otherwise(0.0)
    return share_base * F.lit(p.net_base_price) * F.col(s) + ups


def project_increment(curves: DataFrame, anchors: DataFrame, horizons: Sequence[int], p: Params,
                      by: Sequence[str]) -> DataFrame:
    """Projected money per person for anchor+1..N. anchors: by, anchor, share_base, share_ups."""
    j = curves.join(anchors, [*by]).where(F.col("k") > F.col("anchor"))
    pay = expected_payment(p, F.col("share_base"), F.col("share_ups"))
    j = j.withColumn("_m", pay).withColumn("horizon", F.explode(F.array(*[F.lit(int(n)).cast("bigint") for n in horizons])))
    return j.where(F.col("k") <= F.col("horizon")).groupBy(*by, "horizon").agg(F.sum("_m").alias("increment"))


def ltv_curve(curves: DataFrame, anchors: DataFrame, p: Params, by: Sequence[str]) -> DataFrame:
    """Cumulative value from the anchor on; anchors also carry the observed value."""
    j = curves.join(anchors, [*by]).where(F.col("k") >= F.col("anchor"))
    step = F.when(F.col("k") > F.col("anchor"), expected_payment(p, F.col("share_base"), F.col("share_ups"))).otherwise(0.0)
    w = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumn("ltv", F.col("observed") + F.sum(step).over(w)).select(*by, "k", "ltv")


def cell_summary(pop: DataFrame, web: Web, p: Params, dims: Sequence[str]) -> DataFrame:
    """Counts, ages and observed money of each cell."""
    base = F.col("has_base")
    g = pop.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n_trial"), F.count_if(base).alias("n_base_payer"),
        F.floor(F.avg("age_weeks_now")).alias("avg_age_weeks"), F.sum("total_net").alias("revenue_observed"),
        F.avg("total_net").alias("ltv_per_trial_current"),
        F.coalesce(F.avg(F.when(base, F.col("total_net"))), F.lit(0.0)).alias("ltv_per_base_payer_current"),
        F.avg("base_net").alias("ltv_per_trial_current_base"),
        F.coalesce(F.avg(F.when(base, F.col("base_net"))), F.lit(0.0)).alias("ltv_per_base_payer_current_base"),
        *[F.count_if(base & (F.col("age_weeks_now") >= n + p.return_periods)).alias(f"ltv_{n}_n_mature") for n in p.report_horizons])
    g = g.withColumn("conversion", F.col("n_base_payer") / F.col("n_trial"))
    g = g.withColumn("low_n", F.col("n_base_payer") < p.low_n)
    return g.withColumn("max_week", web.max_week).withColumn("anchor", F.least("avg_age_weeks", "max_week"))


def cell_table(web: Web, state: H.State, p: Params, dims: Sequence[str]) -> DataFrame:
    """LTV per cohort x dims: observed up to the cell's age, the model after it. `dims[0]` is the
    cohort date."""
    pop = N.mature(web.pop, p.min_age)
    ratios = cohort_ratios(L.training_rows(web.mx), state, p)
    cells = cell_summary(pop, web, p, dims)
    obs = checkpoint_observations(web.events, pop, base_ladder(web.events, p), p)
    rates = attach_rates(obs, pop, p, dims).select(*dims, "share_ups")
    wk = R.weekly_net(web.events, pop.where("has_base"), p, [*dims])
    key = cells.select(*dims, "anchor", "max_week", "n_base_payer")
    upto = [("obs", F.col("anchor"))] + [(f"fact_{n}", F.least(F.lit(n).cast("bigint"), F.col("max_week"))) for n in p.report_horizons]
    seen = wk.join(key, [*dims]).groupBy(*dims).agg(*[
        (F.sum(F.when(F.col("week") <= lim, F.col(c)).otherwise(0.0)) / F.first("n_base_payer")).alias(f"{name}{suffix}")
        for name, lim in upto for c, suffix in (("net", ""), ("net_base", "_base"))])
    curves = cell_curves(web.mx, pop, state, ratios, p, dims).join(key, [*dims])
    inside = [(n, (F.col("k") > F.col("anchor")) & (F.col("k") <= n)) for n in p.report_horizons]
    inc = curves.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("_c"),
        *[F.coalesce(F.sum(F.when(c, F.col("s"))), F.lit(0.0)).alias(f"s_{n}") for n, c in inside],
        *[F.coalesce(F.sum(F.when(c & is_checkpoint("k", p), F.col("s"))), F.lit(0.0)).alias(f"u_{n}") for n, c in inside])
    t = cells.join(seen, [*dims], "left").join(inc, [*dims], "left").join(rates, [*dims], "left")
    t = t.join(ratios.select(F.col("app_id").alias("_a"), F.col("hr").alias("hr_cohort")),
               F.col(dims[0]).cast("string") == F.col("_a"), "left").drop("_a")
    t = t.withColumn("hr_cohort", F.coalesce("hr_cohort", F.lit(1.0)))
    has = F.col("_c").isNotNull()
    t = t.withColumn("ups_attach_rate", F.when(has, F.col("share_ups")).otherwise(0.0))
    k_max = state.hazard.agg(F.max("k_max")).scalar()
    cols = []
    for n in p.report_horizons:
        fact = F.lit(n) <= F.col("anchor")
        both = F.col("obs") + p.net_base_price * F.col(f"s_{n}") + F.col("share_ups") * p.net_ups_price * F.col(f"u_{n}")
        only = F.col("obs_base") + p.net_base_price * F.col(f"s_{n}")
        full = F.when(~has, F.col("ltv_per_base_payer_current")).when(fact, F.col(f"fact_{n}")).otherwise(both)
        base = F.when(~has, F.col("ltv_per_base_payer_current_base")).when(fact, F.col(f"fact_{n}_base")).otherwise(only)
        cols += [full.alias(f"ltv_per_base_payer_{n}"), base.alias(f"ltv_per_base_payer_{n}_base"),
                 F.when(has, full * F.col("conversion")).otherwise(F.col("ltv_per_trial_current")).alias(f"ltv_per_trial_{n}"),
                 F.when(has, base * F.col("conversion")).otherwise(F.col("ltv_per_trial_current_base")).alias(f"ltv_per_trial_{n}_base"),
                 F.when(~has, "no_payers").when(fact, "fact").otherwise("model").alias(f"ltv_{n}_source"),
                 F.when(has, F.col(f"ltv_{n}_n_mature")).otherwise(0).alias(f"ltv_{n}_n_mature"),
                 F.when(~has, "none").when(F.lit(n) <= k_max, "web_data").otherwise("ios_tail_extrapolation").alias(f"ltv_{n}_evidence")]
    return t.select(*dims, "n_trial", "n_base_payer", "conversion", "avg_age_weeks", "low_n", "hr_cohort",
                    "ups_attach_rate", "revenue_observed", "ltv_per_trial_current", "ltv_per_base_payer_current",
                    "ltv_per_trial_current_base", "ltv_per_base_payer_current_base", *cols)


def rounded_cells(t: DataFrame) -> DataFrame:
    """Money to cents, rates to four places."""
    out = {}
    for c in t.columns:
        if c.startswith("ltv_per_") or c == "revenue_observed":
            out[c] = F.round(c, 2)
        elif c in ("conversion", "hr_cohort", "ups_attach_rate"):
            out[c] = F.round(c, 4)
    return t.withColumns(out)


def sample_grade(n) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n >= 300, "reliable").when(n >= 100, "directional").when(n >= 30, "rough").otherwise("insufficient")


def weekly_curve(web: Web, state: H.State, p: Params, dims: Sequence[str]) -> DataFrame:
    """One row per cell and week 0..h_ext: observed payers while the week has settled, the anchored
    model after; money follows the cell tables."""
    pop = N.mature(web.pop, p.min_age)
    ladder = base_ladder(web.events, p)
    ups = R.money_events(web.events).where(F.col("event_type") == R.UPSELL)
    payers = pop.where("has_base")
    ratios = cohort_ratios(L.training_rows(web.mx), state, p)
    cells = cell_summary(pop, web, p, dims).select(*dims, "n_base_payer", "avg_age_weeks", "anchor", "max_week")
    settled = F.least(F.col("avg_age_weeks") - math.ceil(p.return_periods), F.col("max_week"))
    cells = cells.withColumn("fact_until", F.greatest(F.lit(0).cast("bigint"), settled))
    rates = attach_rates(checkpoint_observations(web.events, pop, ladder, p), pop, p, dims).select(*dims, "share_ups")
    key = [*dims, "week"]
    obs_b = weekly_payers(ladder, payers, p, dims).withColumnRenamed("payers", "ob")
    obs_u = weekly_payers(ups, payers, p, dims).withColumnRenamed("payers", "ou")
    net = R.weekly_net(web.events, payers, p, [*dims]).select(*key, "net")
    curves = cell_curves(web.mx, pop, state, ratios, p, dims).withColumnRenamed("k", "week")
    weeks = F.sequence(F.lit(0).cast("bigint"), F.lit(p.h_ext).cast("bigint"))
    g = cells.join(rates, [*dims], "left").withColumn("week", F.explode(weeks))
    g = g.join(obs_b, key, "left").join(obs_u, key, "left").join(net, key, "left").join(curves, key, "left")
    cell = Window.partitionBy(*dims)
    upto = cell.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    n, s, week = F.col("n_base_payer"), F.col("s"), F.col("week")
    at = F.col("fact_until") == week
    g = g.withColumns({
        "_has": F.max("s").over(cell).isNotNull(),
        "_mod": F.max(F.when(at, n * s)).over(cell),
        "_seen": F.max(F.when(at, F.coalesce(F.col("ob"), F.lit(0)))).over(cell)})
    scale = F.when((F.col("fact_until") >= 1) & (F.col("_mod") > 0) & (F.col("_seen") > 0),
                   F.col("_seen") / F.col("_mod")).otherwise(1.0)
    fact = week <= F.col("fact_until")
    zero = F.lit(0.0)
    rb = F.when(fact, F.coalesce(F.col("ob").cast("double"), zero)).when(~F.col("_has"), zero).otherwise(n * s * scale)
    g = g.withColumn("rb", rb)
    ru = (F.when(fact, F.coalesce(F.col("ou").cast("double"), zero)).when(~F.col("_has"), zero)
          .when(is_checkpoint("week", p), F.col("rb") * F.col("share_ups")).otherwise(zero))
    money = F.when(n == 0, zero).when(week <= F.col("anchor"), F.coalesce("net", zero)).when(
        F.col("_has"), n * expected_payment(p, F.lit(1.0), F.col("share_ups"), "week")).otherwise(zero)
    g = g.withColumns({"ru": ru, "_money": money})
    k_max = state.hazard.agg(F.max("k_max")).scalar()
    out = g.select(
        *dims, "week", "n_base_payer", sample_grade("n_base_payer").alias("sample_grade"),
        F.round("rb", 4).alias("rebills_base"), F.round("ru", 4).alias("rebills_ups"),
        F.round(F.sum("rb").over(upto), 4).alias("rebills_base_cum"), F.round(F.sum("ru").over(upto), 4).alias("rebills_ups_cum"),
        F.when(n > 0, F.round(F.col("rb") / F.nullif(n, F.lit(0)), 6)).otherwise(zero).alias("active_share"),
        F.round(F.sum("_money").over(upto), 2).alias("revenue_cum"),
        F.when(fact, "fact").when(~F.col("_has"), "no_payers").otherwise("model").alias("source"),
        F.when(week <= k_max, "web_data").otherwise("ios_tail_extrapolation").alias("evidence"))
    before = F.lag("revenue_cum").over(cell.orderBy("week"))
    return out.withColumn("revenue_week", F.round(F.col("revenue_cum") - F.coalesce(before, zero), 2))


# ------------------------------------------------------------------ ratio-based tables
def ratio_table(pop: DataFrame, weekly: DataFrame, shape: DataFrame, p: Params, dims: Sequence[str],
                horizons: Sequence[int], max_week: Column) -> DataFrame:
    """Earlier form of the cell table, one row per cell and horizon: the mean over members old
    enough, else the current value times the growth ratio of the pooled shape.

    Money is summed by cell, by the first horizon that counts its week and by the number of horizons its member is old enough for;
    no row with a member's key is repeated per horizon. Horizons given twice count once; members without an age are attributed but
    never mature. weekly: session_id, week, net_base, net_ups. shape: k, value, ups_value (k from 0)."""
    m = pop.select("session_id", *dims, "age_weeks_now", "base_net", "total_net")
    payer = F.col("total_net") > 0
    cells = m.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n_attributed"), F.count_if(payer).alias("n_payers"),
        F.floor(F.avg("age_weeks_now")).alias("avg_age_weeks"), F.avg("base_net").alias("cur"),
        F.avg("total_net").alias("cur_ups"), F.coalesce(F.avg(F.when(payer, F.col("base_net"))), F.lit(0.0)).alias("cur_p"),
        F.coalesce(F.avg(F.when(payer, F.col("total_net"))), F.lit(0.0)).alias("cur_p_ups"))
    cells = cells.withColumn("low_n", F.col("n_payers") < p.low_n)
    points = [F.lit(n).cast("bigint") for n in sorted({int(n) for n in horizons})]
    m = m.where(F.col("age_weeks_now").isNotNull()).withColumns({
        "_from": F.lit(0), "_gone": VW.first_point(points, lambda h: F.col("age_weeks_now") < h), "_payer": payer})
    count = VW.in_force(m.select(*dims, "_from", "_gone", F.lit(1).alias("n_mature"), F.coalesce("_payer", F.lit(False)).cast("int").alias("n_mature_p")),
                        points, "horizon", dims, ["n_mature", "n_mature_p"], "_from", "_gone")
    net = F.col("net_base") + F.col("net_ups")
    paid = m.join(weekly.withColumn("_last", max_week), "session_id").select(
        *dims, "_gone", VW.first_point(points, lambda h: F.col("week") <= F.least(h, "_last")).alias("_paid"),
        F.col("net_base").alias("b"), F.when(F.col("_payer"), F.col("net_base")).alias("bp"), net.alias("t"), F.when(F.col("_payer"), net).alias("tp"))
    money = VW.in_force(paid, points, "horizon", dims, ["b", "bp", "t", "tp"], "_paid", "_gone")
    sh = shape.agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("value", "ups_value"))))).scalar()
    c = cells.withColumn("horizon", F.explode(F.array(*points))).withColumn("_sh", sh)
    c = c.join(count, [*dims, "horizon"], "left").join(money, [*dims, "horizon"], "left")
    age, h = F.greatest("avg_age_weeks", F.lit(1)), F.col("horizon")
    top = F.lit(p.h_ext).cast("bigint")

    def at(k, field):
        return F.try_element_at("_sh", F.least(k, top))[field]

    def month(k):
        return (F.floor(k / p.ups_every) * p.ups_every).cast("bigint")

    grow = F.try_divide(at(h, "value"), at(age, "value"))
    ups = F.try_divide(at(month(h), "ups_value"), at(month(age), "ups_value"))
    fact = F.col("n_mature").isNotNull()

    def over(a, n):
        return F.when(F.col(n) > 0, F.coalesce(F.col(a), F.lit(0.0)) / F.col(n)).otherwise(0.0)

    base, base_p = F.col("cur") * grow, F.col("cur_p") * grow
    more, more_p = F.col("cur_ups") - F.col("cur"), F.col("cur_p_ups") - F.col("cur_p")
    both, both_p = over("t", "n_mature"), over("tp", "n_mature_p")
    return c.select(
        *dims, "horizon", "n_attributed", "n_payers", "avg_age_weeks", "low_n",
        F.when(fact, over("b", "n_mature")).otherwise(base).alias("ltv_per_attributed"),
        F.when(fact, over("bp", "n_mature_p")).otherwise(base_p).alias("ltv_per_payer"),
        F.when(fact, both).otherwise(base + more).alias("ltv_per_attributed_ups_factonly"),
        F.when(fact, both_p).otherwise(base_p + more_p).alias("ltv_per_payer_ups_factonly"),
        F.when(fact, both).otherwise(base + more * ups).alias("ltv_per_attributed_ups_projected"),
        F.when(fact, both_p).otherwise(base_p + more_p * ups).alias("ltv_per_payer_ups_projected"),
        F.when(fact, "fact").otherwise("model").alias("source"),
        F.coalesce("n_mature", F.lit(0)).cast("bigint").alias("n_mature"),
        F.when(fact, "fact").otherwise("rough_low_data").alias("ups_projection_quality"))


def table_rollup(cells: DataFrame, dim: str, horizons: Sequence[int]) -> DataFrame:
    """Cell table summed over cohorts per `dim`, with a grand total; every mean has its own weight."""
    def wmean(c, w):
        return F.coalesce(F.try_divide(F.sum(F.col(w) * F.col(c)), F.sum(w)), F.lit(0.0))

    aggs = [F.sum("n_trial").alias("n_trial"), F.sum("n_base_payer").alias("n_base_payer")]
    for n in horizons:
        aggs += [wmean(f"ltv_per_trial_{n}", "n_trial").alias(f"ltv_per_trial_{n}"),
                 wmean(f"ltv_per_base_payer_{n}", "n_base_payer").alias(f"ltv_per_base_payer_{n}"),
                 F.coalesce(F.try_divide(F.sum(f"ltv_{n}_n_mature"), F.sum("n_trial")), F.lit(0.0)).alias(f"share_mature_{n}")]
    return cells.rollup(dim).agg(F.grouping(dim).cast("bigint").alias("is_total"), *aggs)


def by_age(cells: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Forecasts grouped by cohort age with their weights."""
    def wmean(c, w):
        return F.try_divide(F.sum(F.col(w) * F.col(c)), F.sum(w))

    aggs = [F.count(F.lit(1)).alias("cells"), F.sum("n_trial").alias("n_trial"), F.sum("n_base_payer").alias("n_base_payer")]
    for n in horizons:
        aggs += [wmean(f"ltv_per_trial_{n}", "n_trial").alias(f"ltv_per_trial_{n}"),
                 wmean(f"ltv_per_base_payer_{n}", "n_base_payer").alias(f"ltv_per_base_payer_{n}")]
    return cells.groupBy("avg_age_weeks").agg(*aggs).where("n_trial > 0")


def observed_by_week(pop: DataFrame, weekly: DataFrame, p: Params, max_week: int, min_people: int = 30) -> DataFrame:
    """Observed cumulative value by week over people old enough for it, up to the first week with too
    few people. Counts per age are spread over weeks, never people."""
    base = F.col("has_base")
    per = pop.groupBy("age_weeks_now").agg(F.count(F.lit(1)).alias("n"), F.count_if(base).alias("nb"))
    w = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max_week).cast("bigint")))
    settled = F.col("age_weeks_now") >= F.col("week") + p.return_periods
    n = per.withColumn("week", w).where(settled).groupBy("week").agg(F.sum("n").alias("n_all"), F.sum("nb").alias("n_base"))
    money = weekly.join(pop.select("session_id", "age_weeks_now", "has_base"), "session_id").groupBy(
        "age_weeks_now", F.col("week").alias("_w")).agg(F.sum("net").alias("m"), F.sum(F.when(base, F.col("net"))).alias("mb"))
    m = money.withColumn("week", w).where(settled & (F.col("_w") <= F.col("week"))).groupBy("week").agg(
        F.sum("m").alias("m"), F.sum("mb").alias("mb"))
    out = n.join(m, "week", "left").select(
        "week", "n_all", "n_base", (F.coalesce("m", F.lit(0.0)) / F.col("n_all")).alias("ltv_all"),
        F.try_divide(F.coalesce("mb", F.lit(0.0)), "n_base").alias("ltv_base"))
    enough = F.min((F.col("n_all") >= min_people).cast("int")).over(Window.partitionBy(F.lit(0)).orderBy("week"))
    return out.withColumn("_ok", enough).where("_ok = 1").drop("_ok")
