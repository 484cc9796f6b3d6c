"""Gates that compare two computations: rows in which they pass and rows in which they must not."""
import datetime as dt
import random

from pyspark.sql import functions as F

from tenurekit.operators import cohorts as K
from tenurekit.operators import quality as Z
from tenurekit.params import ORDERS_WEB as P


def test_reconcile_tables(spark):
    cols = "key string, metric string, value double"
    a = spark.createDataFrame([("x", "m", 1.0), (None, "m", 5e9), ("y", "m", 2.0), ("z", "m", None), ("w", "only", 1.0)], cols)
    b = spark.createDataFrame([("x", "m", 1.0 + 1e-12), (None, "m", 5e9 + 1), ("y", "m", 2.1), ("z", "m", 0.0), ("v", "only", 1.0)], cols)
    got = {(r.key, r.metric): (r.value, r.ok) for r in Z.reconcile_tables(a, b, ["key"]).collect()}
    assert got == {("x", "m"): (1.0, True), (None, "m"): (5e9, True), ("y", "m"): (2.0, False), ("z", "m"): (None, False),
                   ("w", "only"): (1.0, False), ("v", "only"): (None, False)}
    assert Z.reconcile_tables(a.limit(0), b.limit(0), ["key"]).count() == 0


def payments(spark, n=60, seed=3):
    rng, rows, starts = random.Random(seed), [], []
    for s in range(n):
        starts.append((s, dt.date(2024, 1 + 3 * (s % 3), 1)))
        rows += [(s, k, 20.0 + rng.randrange(40) / 4) for k in range(rng.randrange(0, 9))]
    return (spark.createDataFrame(rows, "sub_id long, rebill_number long, amount double"), spark.createDataFrame(starts, "sub_id long, cohort date"))


def test_facts_meet_the_payments_and_a_lost_payment_shows(spark):
    now = F.lit(f"{dt.date(2024, 7, 1) + dt.timedelta(days=4 * P.period_days)} 00:00:00").cast("timestamp")  # the last cohort is young
    rows, members = payments(spark)
    totals = K.fact_totals(K.cohort_facts(rows, members, now, P))
    out = Z.reconcile_tables(totals, K.payment_totals(rows, members, now, P), ["cohort"]).collect()
    assert all(r.ok for r in out) and len(out) >= 3 * 3
    lost = rows.where("not (sub_id % 3 = 0 and rebill_number = 1 and sub_id < 20)")
    bad = {(str(r.cohort), r.metric) for r in Z.reconcile_tables(totals, K.payment_totals(lost, members, now, P), ["cohort"]).collect() if not r.ok}
    assert ("2024-01-01", "revenue") in bad and ("2024-01-01", "payments") in bad and {c for c, _ in bad} == {"2024-01-01"}
