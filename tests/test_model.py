"""Identities of the hazard model, and folds against plain refits."""
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tenurekit.functions.ordered import cut
from tenurekit.operators import calibrate as C
from tenurekit.operators import evaluate as E
from tenurekit.operators import hazard as H
from tenurekit.operators import ladder as L
from tenurekit.operators import ltv as V
from tenurekit.operators import survival as S
from tenurekit.params import MOBILE, ORDERS, ORDERS_WEB
from tenurekit.plans.ladder_plans import orders_mx

SF = "/root/testdata/sf0.001"
SMALL = replace(ORDERS, min_payers=5, min_mature=5, min_risk=5, min_rows=20, hr_min_n=5, crash_min_risk=10, crash_floor=0.05)
SMALL_WEB = replace(ORDERS_WEB, min_risk=5, min_rows=20, hr_min_n=5, min_cohorts=2)


def test_no_levers_no_ratio_is_the_running_product(spark):
    h = [0.30 - 0.27 * i / 51 for i in range(52)]
    hz = spark.createDataFrame([(i + 1, x) for i, x in enumerate(h)], "step_k long, h double")
    g = spark.createDataFrame([("a", 3, 1.0, 1.0), ("a", 7, 1.0, 1.0)], "app_id string, w long, mult double, hr double")
    got = [r["s"] for r in H.mixture_curve(g, hz, MOBILE, ["app_id"]).orderBy("k").collect()]
    s, want = 1.0, []
    for x in h:
        s *= 1 - x
        want.append(s)
    assert got == pytest.approx(want, abs=1e-12)
    assert all(a >= b for a, b in zip(got, got[1:])) and 0 < got[-1] <= 1


def test_unknown_levers_count_one(spark):
    p = replace(MOBILE, levers=("geo",))
    m = spark.createDataFrame([("geo", "x", "x", 1.7, 10)], "lever string, raw string, cat string, mult double, n long")
    got = {r["geo"]: r["mult"] for r in H.personal_multiplier(spark.createDataFrame([("x",), ("new",)], "geo string"), m, p).collect()}
    assert got == {"x": 1.7, "new": 1.0}


def test_hazard_gap_forms(spark):
    hz = spark.createDataFrame([(1, 0.5), (3, 0.5)], "step_k long, h double")
    g = spark.createDataFrame([("a", 1, 1.0, 1.0)], "app_id string, w long, mult double, hr double")
    p = replace(MOBILE, hmax=3)

    def s(gap):
        return [r["s"] for r in H.mixture_curve(g, hz, p, ["app_id"], gap=gap).orderBy("k").collect()]

    assert s("null") == [0.5, None, None]
    assert s("zero") == pytest.approx([0.5, 0.5, 0.25])
    own = hz.withColumn("votes", F.lit(9).cast("bigint"))
    filled = [r["h"] for r in H.splice_hazard(own, replace(p, h_ext=4)).orderBy("step_k").collect()]
    assert filled == pytest.approx([0.5, 0.5, 0.5, 0.5])


@pytest.fixture(scope="module")
def mx(spark):
    return cut(orders_mx(spark, SF))


def test_loo_fold_equals_a_refit_without_the_app(spark, mx):
    apps = S.payers(mx).where("payers >= 5").select("app_id")
    st = E.loo_fit(mx, SMALL, apps)
    one = sorted(r[0] for r in apps.collect())[0]
    ref = H.fit(mx.where(F.col("app_id") != one), SMALL)
    a = {r["step_k"]: r["h"] for r in st.hazard.where(F.col("fold") == one).collect()}
    b = {r["step_k"]: r["h"] for r in ref.hazard.collect()}
    assert a == pytest.approx(b)
    m = {(r["lever"], r["raw"]): r["mult"] for r in st.mult.where(F.col("fold") == one).collect()}
    n = {(r["lever"], r["raw"]): r["mult"] for r in ref.mult.collect()}
    assert m == pytest.approx(n)
    got = {(r["weeks"], r["k"]): r["s"] for r in E.loo_predict(mx, st, SMALL, (2,)).where(F.col("app_id") == one).collect()}
    want = {(r["weeks"], r["k"]): r["s"] for r in H.predict(mx.where(F.col("app_id") == one), ref, SMALL, ["app_id"], (2,)).collect()}
    assert got == pytest.approx(want)


@pytest.fixture(scope="module")
def web(spark):
    from tenurekit.sources.adapters import web_events
    return V.prepare(web_events(spark, SF), SMALL_WEB, cohort_unit="year")


@pytest.mark.parametrize("levers", [None, ("geo",), ()])
def test_cohort_fold_equals_plain_refits(spark, mx, web, levers):
    p, weeks = SMALL_WEB, 3
    donor = cut(H.portfolio_hazard(mx, SMALL))
    folds = E.cohort_folds(web, p, donor, (weeks,), (1, 2), min_subs=10, min_mature=3, levers=levers)
    got = {(r["fold"], r["k"]): r for r in folds.collect()}
    assert got
    one = min(got)[0]
    used = p.levers if levers is None else levers
    q = replace(p, levers=used) if used else p
    train = L.training_rows(web.mx).where(F.col("app_id") != one)
    h = H.splice_hazard(H.portfolio_hazard(train, p), p, donor)
    mult = H.residual_multipliers(H.clean_cells(train, p), h, p, levers=used)
    st = H.State(cut(h), cut(mult) if used else mult)

    def curve(rows):
        vis = L.visible_by_step(rows, weeks).withColumn("g", F.lit(1))
        cells = H.ratio_cells(vis, p, ["g"])
        hr = H.hazard_ratio(cells, st, p, ["g"], levers=used)
        mix = H.personal_multiplier(H.combos(vis, p, ["g"]), mult, p, levers=used).join(hr.select("g", "hr"), "g", "left")
        c = H.mixture_curve(mix.withColumn("hr", F.coalesce("hr", F.lit(1.0))), st.hazard, p, ["g"], p.h_ext)
        return {r["k"]: r["s"] for r in c.collect()}

    own, pooled = curve(web.mx.where(F.col("app_id") == one)), curve(train)
    facts = {r["k"]: r["fact"] for r in S.direct_survival(web.mx.where(F.col("app_id") == one), q, offset=p.return_periods).collect()}
    for (fold, k), r in got.items():
        if fold == one:
            assert r["v3"] == pytest.approx(own[k]) and r["v2"] == pytest.approx(pooled[k])
            assert r["actual"] == pytest.approx(facts[k])


def test_weekly_curve_totals_agree_across_breakdowns(spark, mx, web):
    st = H.fit(L.training_rows(web.mx), SMALL_WEB, donor=H.portfolio_hazard(mx, SMALL), splice=True)
    st = H.State(cut(st.hazard), cut(st.mult))
    tot = []
    for dims in (["cohort_date", "geo"], ["cohort_date", "ad_name"]):
        c = V.weekly_curve(web, st, SMALL_WEB, dims).where("week = 0")
        tot.append(c.agg(F.sum("rebills_base"), F.sum("n_base_payer")).first())
    assert tot[0] == tot[1]


def test_correction_shape(spark):
    fit = spark.createDataFrame([(0.0, 0.1, 2)], "alpha double, beta double, k_max long")
    got = [r["c"] for r in C.correction(fit, 7).orderBy("step_k").collect()]
    import math
    e = math.exp(0.1)
    assert got == pytest.approx([1.0, e, e * 0.75 + 0.25, e * 0.5 + 0.5, e * 0.25 + 0.75, 1.0, 1.0])


def test_splice_by_a_ladder_of_donors(spark):
    """Own steps to k_max; then the near donor scaled to meet there, then the wide one; a group without votes follows its donors as they are."""
    own = spark.createDataFrame([("a", 1, 0.4, 9), ("a", 2, 0.2, 9), ("a", 3, 0.9, 1), ("b", 1, 0.8, 1)], "geo string, step_k long, h double, votes long")
    near = spark.createDataFrame([("r", 1, 0.3), ("r", 2, 0.1), ("r", 3, 0.3)], "region string, step_k long, h double")
    wide = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.2), (4, 0.1)], "step_k long, h double")
    groups = spark.createDataFrame([("a", "r"), ("a", "r"), ("b", "s"), ("c", "r")], "geo string, region string")
    out = H.splice_hazard(own, replace(MOBILE, h_ext=5, hmax=4), by=["geo"], donors=[(near, ["region"]), (wide, [])], groups=groups)
    got = {(r.geo, r.step_k): (r.h, r.k_max) for r in out.collect()}
    want = {"a": [0.4, 0.2, 0.6, 0.05, 0.05], "b": [0.5, 0.4, 0.2, 0.1, 0.1], "c": [0.3, 0.1, 0.3, 0.1, 0.1]}
    assert {k: v[0] for k, v in got.items()} == pytest.approx({(g, k + 1): h for g, hs in want.items() for k, h in enumerate(hs)})
    assert {g: m for (g, _), (_, m) in got.items()} == {"a": 2, "b": 0, "c": 0}
