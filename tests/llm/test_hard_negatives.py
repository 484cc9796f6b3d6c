import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenurekit.llm import hard_negatives as hn


def plain(rows, ask=hn.ASK, scale=256):
    """Brute force: Python integers, all pairs."""
    fit = [(i, lab, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v, lab in rows
           if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for a, (i, lab, v) in enumerate(fit):
        if i is None or i % 100:
            continue
        scored = [(j, sum(x * y for x, y in zip(v, w)), other) for k, (j, other, w) in enumerate(fit) if k != a]
        for p, ps, _ in sorted((x for x in scored if x[2] == lab), key=order)[:ask.positives]:
            good = [x for x in scored if x[2] != lab and ask.low * ps <= 100 * x[1] <= ask.high * ps]
            out += [(i, p, r, j, ps, s) for r, (j, s, _) in enumerate(sorted(good, key=order)[:ask.negatives], 1)]
    return sorted(map(str, out))


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.withColumn("key", F.lit("x")).withColumn("p", F.lit(1)).withColumn("score", F.lit(0)).withColumn("x", F.lit(0))
    return sorted(str(tuple(r)) for r in hn.hard_negatives(df.repartition(3), **more).collect())


def test_scores_are_exact():
    rng = np.random.default_rng(5)
    for d, most in ((1, 1), (8, 100), (13, 200), (64, 300), (64, 1 << 20), (3, 1 << 29)):
        a, c = rng.integers(-most, most + 1, (7, d)), rng.integers(-most, most + 1, (50, d))
        wide = np.int32 if d * most * most < 1 << 30 else np.int64
        assert np.array_equal(hn.scores(hn.subset_sums(a), hn.planes(c), wide), c @ a.T)
    assert hn.planes(np.zeros((2, 3), np.int64)).shape == (1, 1, 2)
    s = np.array([0, 1, -1, 7, 199, -250, 2**62], np.int64)
    low, high = hn.limits(s, hn.ASK)
    assert low.tolist() == [-(-30 * int(x) // 100) for x in s] and high.tolist() == [90 * int(x) // 100 for x in s]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "GROUP_LEAST", 100)
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, 0.15), 2) for _ in range(12)], rng.choice([0, 0, 1, 2, -1])) for i in range(420)]
    got = mined(spark, rows)
    assert got == plain(rows) and len(got) > 100
    ask = hn.Ask(positives=2, negatives=3, low=10, high=120)
    assert mined(spark, rows, ask=ask, scale=1000) == plain(rows, ask, 1000)


def test_ties_repeats_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    v, w = [0.5, 0.5, 0.0], [0.3, 0.3, 0.0]
    rows = [(0, v, 1), (0, v, 1), (0, w, 1), (100, v, 1), (200, [0.5], 7), (300, v, None), (None, v, 1), (None, w, 2), (5, w, 2), (5, w, 2), (4, w, 2),
            (6, None, 2), (7, [0.1, None, 0.2], 2), (8, [nan, 0.0, 0.1], 2), (9, [inf, 0.0, 0.1], 1), (10, [], 2), (11, [0.3], 3), (12, w + [0.9] * 20, 2)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, rows * 30) == plain(rows * 30)
    assert mined(spark, []) == [] and mined(spark, [(100, v, 1)]) == [] and mined(spark, [(None, v, 1), (7, w, 2)]) == []


def test_numbers_beyond_64_bits_stop(spark):
    with pytest.raises(Exception, match="(?i)exceed 64 bits|overflow"):
        mined(spark, [(0, [1e15], 1), (1, [1e15], 1), (2, [1e15], 2)])
