"""Logistic models and samples on small frames."""
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tenurekit.operators import ml as M
from tenurekit.operators import sample as U
from tenurekit.params import MOBILE


@pytest.fixture(scope="module")
def mx(spark):
    # two geos with survival 3/4 and 1/4 at every step; levers otherwise equal
    df = spark.range(4000).selectExpr(
        "id sub_id", "1L + id % 2 step_k", "9.0D weeks_obs", "if(id % 4 < 2, 'a', 'b') geo", "'m' media_source", "'s' attribution_source",
        "'week' plan_interval", "'2024-01' cohort_month", "1L billing_day_of_month", "cast(null as bigint) trial_days",
        "if(id % 4 < 2, 'app1', 'app2') app_id", "int(id / 4) % 4 q")
    df = df.withColumn("survived", F.when(F.col("geo") == "a", F.col("q") < 3).otherwise(F.col("q") < 1).cast("bigint"))
    return df.withColumn("died", 1 - F.col("survived"))


P = replace(MOBILE, hmax=2, min_risk=10)


def test_fitted_risk_equals_the_observed_share(spark, mx):
    m = M.fit(mx, P)
    cells = M.features(mx, m.tops, P).select(*M.CATS, *M.NUMS).distinct()
    got = {(r["geo"], r["step_bin"]): r["p"] for r in M.survive(m.pipeline, cells).collect()}
    for (geo, _), p in got.items():
        assert p == pytest.approx(0.75 if geo == "a" else 0.25, abs=0.02)


def test_relative_risk_points_the_right_way(spark, mx):
    m = M.fit(mx, P)
    for version in (1, 2):
        rr = {r["app_id"]: r["rr"] for r in M.relative_risk(mx, m, replace(P, hmax=8), version).collect()}
        assert rr["app1"] < 1 < rr["app2"]


def test_equal_app_weight_sums_to_one(mx):
    got = M.equal_app_weight(mx.where("app_id = 'app1' or sub_id < 400")).groupBy("app_id").agg(F.sum("app_weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(1.0) for r in got)


def test_calibration_bins(spark):
    t = spark.range(1000).selectExpr("id / 1000.0D p", "cast(id % 2 as double) label", "1.0D w")
    got = M.calibration(t).orderBy("bin").collect()
    assert len(got) == 10 and sum(r["n"] for r in got) == 1000
    assert all(abs(r["n"] - 100) <= 1 and r["real"] == pytest.approx(0.5, abs=0.02) for r in got)


def test_stratified_picks(spark):
    k = spark.range(300).selectExpr("id key", "if(id % 3 = 0, 'x', 'y') grp", "id % 2 = 0 even", "id % 5 = 0 five")
    strata = [("even", "x", F.col("even"), 3), ("five", "x", F.col("five"), 3), ("even", "y", F.col("even"), 2)]
    a = U.stratified(k, "key", "grp", strata, 8, 1).collect()
    assert len({r["key"] for r in a}) == len(a) == 16
    n = {}
    for r in a:
        n[(r["grp"], r["stratum"])] = n.get((r["grp"], r["stratum"]), 0) + 1
    assert n == {("x", "even"): 3, ("x", "five"): 3, ("x", "fill"): 2, ("y", "even"): 2, ("y", "fill"): 6}
    assert sorted(map(tuple, a)) == sorted(map(tuple, U.stratified(k, "key", "grp", strata, 8, 1).collect()))


def test_bounded_sample_repeats(spark):
    df = spark.range(1000)
    a, b = (sorted(r["id"] for r in U.bounded_sample(df.repartition(n), ["id"], 50, 3).collect()) for n in (1, 7))
    assert a == b and len(a) == 50
    assert U.bounded_sample(df, ["id"], 5000).count() == 1000
