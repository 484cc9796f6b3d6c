"""Counts at several points against the matrix as it was known at each of them."""
from __future__ import annotations

import datetime as dt
import random
from dataclasses import replace

from pyspark.sql import functions as F

from tenurekit.operators import evaluate as E
from tenurekit.operators import hazard as H
from tenurekit.operators import ladder as L
from tenurekit.operators import ltv as V
from tenurekit.operators import survival as S
from tenurekit.operators import views as VW
from tenurekit.params import ORDERS

P = replace(ORDERS, period_days=10.0, min_risk=2, min_rows=3, min_payers=2, crash_min_risk=3, crash_floor=0.5, hr_min_n=1, min_mature=1, horizons=(1, 2, 3), hmax=6)
DAY0 = dt.datetime(2024, 1, 1)
CUTS = ("2024-03-31", "2024-02-15", "2023-01-01")
LEVERS = [*P.levers]


def matrix(spark, n=90, seed=5):
    """Keys of four applications with payments about every ten days; levers that change from step to step, some null."""
    rng, rows = random.Random(seed), []
    for s in range(n):
        start, now = rng.randrange(0, 80), 110.0
        day, app = float(start), f"a{s % 4}"
        for k in range(1, rng.randrange(2, 8)):
            rows.append((s, k, DAY0 + dt.timedelta(days=day), (now - start) / 10.0, app, rng.choice(["x", "y", "", None]), rng.choice(["m", "n"]), rng.randrange(1, 32), 1 + start % 31))
            day += rng.choice([9.0, 10.0, 12.5, 20.0])
    cols = "sub_id long, step_k long, pay_ts timestamp, weeks_obs double, app_id string, geo string, media_source string, billing_day_of_month long, first_billing_day long"
    mx = spark.createDataFrame(rows, cols)
    died = (F.xxhash64("sub_id", "step_k") % 3 == 0).cast("long")
    return mx.withColumn("died", died).withColumn("survived", 1 - died)


def counts(df, *cols):
    return sorted(map(str, ([r[c] for c in cols] for r in df.collect())))


def test_calendar_views_are_the_matrix_as_of_each_cutoff(spark):
    mx = matrix(spark)
    points = [F.lit(c).cast("timestamp") for c in sorted(CUTS)]
    cube = VW.calendar_cube(mx, points, P, ["app_id"])
    key = ["app_id", "step_k", *LEVERS]
    seen = VW.at_points(cube, points, "t", key, ["n", "died"], "seen")
    old = VW.at_points(cube, points, "t", key, ["n", "surv"], "old")
    first = cube.select("app_id", "step_k", *VW.first_levers(P), "older", "n", "died")
    older = VW.at_points(first, points, "t", key, ["n", "died"], "older")
    for c in CUTS:
        t = F.lit(c).cast("timestamp")
        view = H.lever_columns(L.as_of(mx, t, P), P)
        ask = lambda df: df.where(F.col("t") == t)
        assert counts(ask(seen), *key, "n", "died") == counts(view.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("died").alias("died")), *key, "n", "died")
        settled = view.where("weeks_obs >= step_k").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("survived").alias("surv"))
        assert counts(ask(old), *key, "n", "surv") == counts(settled, *key, "n", "surv")
        assert counts(ask(older), *key, "n", "died") == counts(H.ratio_cells(L.as_of(mx, t, P), P, ["app_id"]), *key, "n", "died")


def test_calendar_state_equals_a_fit_per_cutoff(spark):
    mx = matrix(spark, 160, 8)
    cutoffs = ("2024-02-20", "2024-03-31")
    points = [F.lit(c).cast("timestamp") for c in cutoffs]
    state = E.calendar_state(VW.calendar_cube(mx, points, P, ["app_id"]), points, P)
    for c in cutoffs:
        t = F.lit(c).cast("timestamp")
        view = L.as_of(mx, t, P)
        crash = S.crash_flags(view, P).where("crash").join(S.payers(view).where(F.col("payers") >= P.min_payers), "app_id", "left_semi")
        h = H.portfolio_hazard(view, P)
        m = H.residual_multipliers(H.clean_cells(view, P, crash), h, P)
        assert counts(state.hazard.where(F.col("t") == t), "step_k", "h", "votes") == counts(h, "step_k", "h", "votes")
        cols = ["lever", "raw", "cat", F.round("mult", 9).alias("m"), "n"]
        got, want = (counts(x.select(*cols), "lever", "raw", "cat", "m", "n") for x in (state.mult.where(F.col("t") == t), m))
        assert got == want


def test_visible_views_end_with_the_age_of_the_key(spark):
    mx = matrix(spark)
    weeks = [1, 4]
    points = [F.lit(w).cast("bigint") for w in weeks]
    key = ["app_id", "step_k", *LEVERS]
    cube = VW.visible_cube(mx, weeks, P, ["app_id"]).select("app_id", "step_k", *VW.first_levers(P), "seen", "gone", "n", "died")
    got = VW.at_points(cube, points, "weeks", key, ["n", "died"], "seen", "gone")
    for w in weeks:
        view = H.lever_columns(L.visible_by_age(mx, w, P), P)
        want = view.groupBy("app_id", "step_k", *VW.first_levers(P)).agg(F.count(F.lit(1)).alias("n"), F.sum("died").alias("died"))
        assert counts(got.where(F.col("weeks") == w), *key, "n", "died") == counts(want, *key, "n", "died")


def test_no_row_is_copied_per_point(spark):
    """The matrix is counted before anything is exploded."""
    mx = matrix(spark)
    points = [F.lit(c).cast("timestamp") for c in sorted(CUTS)]
    plan = VW.at_points(VW.calendar_cube(mx, points, P, ["app_id"]), points, "t", ["app_id", "step_k"], ["n"], "old")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # the plan is printed from its end


def test_empty_matrix_and_points_that_nothing_reaches(spark):
    mx = matrix(spark)
    before = [F.lit("2020-01-01").cast("timestamp")]
    assert VW.at_points(VW.calendar_cube(mx, before, P, ["app_id"]), before, "t", ["app_id"], ["n"], "seen").count() == 0
    points = [F.lit(c).cast("timestamp") for c in sorted(CUTS)]
    assert VW.at_points(VW.calendar_cube(mx.limit(0), points, P, ["app_id"]), points, "t", ["app_id"], ["n"], "seen").count() == 0


def test_frozen_backtest_by_a_foreign_state_per_group(spark):
    """A state keyed by group gives what each group's own state gives alone."""
    mx = matrix(spark, 120, 3)
    one, two = (H.fit(mx.where(F.col("app_id") == a), P) for a in ("a0", "a1"))
    key = lambda df, a: df.withColumn("app_id", F.lit(a))
    both = H.State(*(key(getattr(one, x), "a2").unionByName(key(getattr(two, x), "a3")) for x in ("hazard", "mult")))
    part = mx.where("app_id in ('a2', 'a3')")
    cols = ("app_id", "t", "horizon", "fact", "p", "n_mature")
    out = E.frozen_backtest(part, both, CUTS, P, ["app_id"], state_by=["app_id"]).withColumn("p", F.round("predicted", 9))
    got = counts(out, *cols)
    want = [x for a, st in (("a2", one), ("a3", two))
            for x in counts(E.frozen_backtest(mx.where(F.col("app_id") == a), st, CUTS, P, ["app_id"]).withColumn("p", F.round("predicted", 9)), *cols)]
    assert got == sorted(want) and len(got) > 4


def people(spark, n=70, seed=11):
    """Members of three cells with ages from none to 14 weeks, and what they paid by week (before entry and after the last week too)."""
    rng = random.Random(seed)
    weekly = [(s, w, rng.choice([0.0, 3.5, 9.25, -2.0]), rng.choice([0.0, 1.75])) for s in range(n) for w in rng.sample(range(-1, 16), rng.randrange(6))]
    pop = []
    for s in range(n):
        mine = [x for x in weekly if x[0] == s]
        pop.append((s, rng.choice("abc"), rng.choice([None, *range(15)]), sum((x[2] for x in mine), 0.0), sum((x[2] + x[3] for x in mine), 0.0)))
    return pop, weekly


def ratio_rows(spark, pop, weekly, horizons, last=9):
    left = spark.createDataFrame(pop, "session_id long, cell string, age_weeks_now long, base_net double, total_net double")
    right = spark.createDataFrame(weekly, "session_id long, week long, net_base double, net_ups double")
    shape = spark.createDataFrame([(k, 1.0 + k, 2.0 + k) for k in range(P.h_ext + 1)], "k long, value double, ups_value double")
    return V.ratio_table(left, right, shape, P, ["cell"], horizons, F.lit(last).cast("bigint"))


def test_ratio_table_against_members_one_by_one(spark):
    pop, weekly = people(spark)
    rows = {(r.cell, r.horizon): r for r in ratio_rows(spark, pop, weekly, (12, 4, 8, 4, 14, 30)).collect()}
    assert len(rows) == 3 * 5 and {r.source for r in rows.values()} == {"fact", "model"}
    for (cell, h), r in rows.items():
        mine = [x for x in pop if x[1] == cell]
        old = {x[0]: x[4] > 0 for x in mine if x[2] is not None and x[2] >= h}
        assert (r.n_attributed, r.n_payers, r.n_mature) == (len(mine), sum(x[4] > 0 for x in mine), len(old))
        paid = [(s, b, u) for s, w, b, u in weekly if s in old and w <= min(h, 9)]
        if old:
            payers = sum(old.values())
            want = (sum(b for _, b, _ in paid) / len(old), sum(b for s, b, _ in paid if old[s]) / payers if payers else 0.0,
                    sum(b + u for _, b, u in paid) / len(old), sum(b + u for s, b, u in paid if old[s]) / payers if payers else 0.0)
            got = (r.ltv_per_attributed, r.ltv_per_payer, r.ltv_per_attributed_ups_factonly, r.ltv_per_payer_ups_factonly)
            assert all(abs(a - b) < 1e-9 for a, b in zip(got, want)) and r.source == "fact"
        else:
            age = max(1, sum(x[2] for x in mine if x[2] is not None) // sum(x[2] is not None for x in mine))
            grown = sum(x[3] for x in mine) / len(mine) * (1.0 + min(h, P.h_ext)) / (1.0 + min(age, P.h_ext))
            assert abs(r.ltv_per_attributed - grown) < 1e-9 and r.source == "model"


def test_ratio_table_of_nobody_and_of_cells_without_money(spark):
    pop, weekly = people(spark)
    assert ratio_rows(spark, pop[:0], weekly, (4,)).count() == 0
    free = ratio_rows(spark, pop, weekly[:0], (0,)).collect()
    assert {(r.source, r.ltv_per_attributed, r.ltv_per_payer) for r in free} == {("fact", 0.0, 0.0)}


def test_no_member_is_repeated_per_horizon(spark):
    """Below every explode over horizons the rows are already counts."""
    pop, weekly = people(spark)
    plan = ratio_rows(spark, pop, weekly, (4, 8))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "Generate" in line:
            below = lines[i + 1:]
            end = next((j for j, x in enumerate(below) if depth(x) <= depth(line)), len(below))
            assert any("Aggregate" in x for x in below[:end])


def test_parts_in_force_are_added_up(spark):
    rng = random.Random(2)
    cells = [(rng.choice("ab"), rng.randrange(5), rng.randrange(5), rng.randrange(1, 100) / 8) for _ in range(60)]
    points = [F.lit(x).cast("bigint") for x in (3, 5, 8, 13)]
    got = VW.in_force(spark.createDataFrame(cells, "g string, a int, b int, x double"), points, "at", ["g"], ["x"], "a", "b").collect()
    want = {}
    for g, a, b, x in cells:
        for i in range(a, min(b, 4)):
            want[g, (3, 5, 8, 13)[i]] = want.get((g, (3, 5, 8, 13)[i]), 0) + x
    assert {(r.g, r["at"]): r.x for r in got} == want
