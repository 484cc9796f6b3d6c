"""Plans that don't hold those of the steps before them, many times over."""
from tenurekit.operators import hazard as H
from tenurekit.params import ORDERS_WEB as P


def test_multipliers_of_many_levers_keep_a_small_plan(spark):
    rows = [(f"a{i % 2}", f"b{i % 3}", f"c{i % 5}", f"d{i % 7}", 1, 1000, 100 + 40 * (i % 2)) for i in range(210)]
    cells = spark.createDataFrame(rows, "a string, b string, c string, d string, step_k bigint, n bigint, died bigint")
    hazard = spark.createDataFrame([(1, 0.12)], "step_k bigint, h double")
    m = H.residual_multipliers(cells, hazard, P, levers=("a", "b", "c", "d"))
    found = {(r.lever, r.raw): r.mult for r in m.collect()}
    assert len(found) == 2 + 3 + 5 + 7
    assert abs(found["a", "a0"] - 100 / 120) < 1e-9 and abs(found["a", "a1"] - 140 / 120) < 1e-9 and abs(found["d", "d3"] - 1) < 1e-9
    assert len(m._jdf.queryExecution().toString()) < 20_000
