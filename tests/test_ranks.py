"""Percentiles by rank give numpy's percentiles, whatever the shape of the values."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenurekit.functions.ordered import Ordered
from tenurekit.functions.ranks import percentiles

POINTS = (0.0, 0.1, 0.5, 0.95, 1.0)


@pytest.mark.parametrize("slices", [1, 8])
def test_percentiles(spark, monkeypatch, slices):
    monkeypatch.setattr(Ordered, "default_slices", slices)
    r = random.Random(3)
    data = [("all distinct", r.random()) for _ in range(400)] + [("equal", 2.5)] * 90 + [(None, float(r.randrange(6))) for _ in range(71)]
    data += [("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, x double")
    got = {x["k"]: x for x in percentiles(df, "x", POINTS, ["k"]).collect()}
    for key in {k for k, _ in data} - {"none"}:
        values = [v for k, v in data if k == key]
        assert [got[key][f"q{i}"] for i in range(len(POINTS))] == pytest.approx(list(np.quantile(values, POINTS)))
        assert (got[key]["n"], got[key]["top"]) == (len(values), max(values))
    assert "none" not in got


def test_weights_and_a_column_named_n(spark):
    df = spark.createDataFrame([(1.0, 3), (4.0, 1), (9.0, 2)], "n double, w long")
    want = np.quantile([1, 1, 1, 4, 9, 9], [0.25, 0.5, 0.9])
    r = percentiles(df, "n", [0.25, 0.5, 0.9], weight="w").collect()[0]
    assert [r.q0, r.q1, r.q2] == pytest.approx(list(want)) and r["n"] == 6
    assert percentiles(df.where(F.lit(False)), "n", [0.5]).count() == 0
