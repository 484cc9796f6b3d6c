"""Calendar reporting and month-by-month projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.functions.exprs import DAY_US, days_between
from tenurekit.operators.survival import grid
from tenurekit.params import Params


def month_of(ts) -> Column:
    return F.date_format(ts, "yyyy-MM")


def monthly_revenue(payments: DataFrame, providers: Sequence[str]) -> DataFrame:
    """Revenue by calendar month, one column per provider, and the total."""
    g = payments.groupBy(month_of("ts").alias("month")).agg(
        *[F.coalesce(F.sum(F.when(F.col("provider") == x, F.col("amount"))), F.lit(0.0)).alias(x) for x in providers],
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("payments"))
    return g


def monthly_starts(subs: DataFrame) -> DataFrame:
    return subs.groupBy(month_of("start_ts").alias("month")).agg(F.count(F.lit(1)).alias("new_subs"))


def reconcile_months(payments: DataFrame, excluded: DataFrame, tol: float = 0.01, key: str = "sub_id") -> DataFrame:
    """Do month sums per provider equal gross less the excluded keys?"""
    flag = payments.join(excluded.select(key, F.lit(True).alias("_x")), key, "left").withColumn("_x", F.coalesce("_x", F.lit(False)))
    gross = flag.groupBy("provider").agg(F.sum("amount").alias("gross"), F.coalesce(F.sum(F.when(F.col("_x"), F.col("amount"))), F.lit(0.0)).alias("excluded"))
    months = payments.join(excluded.select(key), key, "left_anti").groupBy("provider", month_of("ts").alias("month")).agg(F.sum("amount").alias("m"))
    got = months.groupBy("provider").agg(F.sum("m").alias("month_sum"), F.count(F.lit(1)).alias("months"))
    out = gross.join(got, "provider", "left").withColumn("expected", F.col("gross") - F.col("excluded"))
    return out.withColumn("ok", F.abs(F.coalesce("month_sum", F.lit(0.0)) - F.col("expected")) <= tol)


def month_growth(monthly: DataFrame, value: str = "total") -> DataFrame:
    """Change against the previous month present (months are few: one row per calendar month)."""
    prev = F.lag(value).over(Window.partitionBy(F.lit(0)).orderBy("month"))
    return monthly.withColumn("growth", F.try_divide(F.col(value) - prev, prev))


def alive_table(starts: DataFrame, deaths: DataFrame, at: Column, p: Params, key: str = "sub_id") -> DataFrame:
    """Keys started before `at`, their period of life then, and whether they were alive."""
    d = deaths.groupBy(key).agg(F.min("death_ts").alias("death_ts"))
    s = starts.where(F.col("start_ts") < at).join(d, key, "left")
    week = F.greatest(F.floor(days_between(F.col("start_ts"), at) / float(p.period_days)), F.lit(0).cast("bigint"))
    return s.withColumn("week_now", week).withColumn("alive", F.col("death_ts").isNull() | (F.col("death_ts") >= at))


def increments(curve: DataFrame, fit: DataFrame, anchor: int, weeks: int, with_week0: bool = False) -> DataFrame:
    """Increment per week: observed up to the anchor (never negative), the fitted decay after it."""
    diff = F.col("cum_avg") - F.lag("cum_avg").over(Window.partitionBy(F.lit(0)).orderBy("week"))
    if with_week0:
        diff = F.when(F.col("week") == 0, F.col("cum_avg")).otherwise(diff)
    obs = curve.select("week", diff.alias("inc")).where(F.col("week") <= anchor)
    g = grid(fit.select("a", "r"), "week", 0, weeks - 1).join(obs, "week", "left")
    model = F.col("a") * F.pow("r", F.col("week").cast("double"))
    return g.select("week", F.when(F.col("inc").isNotNull(), F.greatest("inc", F.lit(0.0))).otherwise(model).alias("inc"))


def project_base(alive: DataFrame, inc: DataFrame, months: Sequence[str], p: Params, weeks: int) -> DataFrame:
    """Month sums of the future weeks of living keys. Keys are first counted per (start, week)."""
    c = alive.where("alive").groupBy("start_ts", "week_now").agg(F.count(F.lit(1)).alias("n"))
    g = grid(c, "week", F.col("week_now") + 1, F.lit(weeks - 1).cast("bigint"))
    when = F.timestamp_micros(F.unix_micros("start_ts") + F.col("week") * F.lit(int(p.period_days * DAY_US)))
    g = g.withColumn("month", month_of(when)).where(F.col("month").isin(*months))
    per = g.groupBy("month", "week").agg(F.sum("n").alias("n")).join(inc, "week")
    got = per.groupBy("month").agg(F.sum(F.col("n") * F.col("inc")).alias("amount"))
    return _every_month(got, months)


def _every_month(df: DataFrame, months: Sequence[str]) -> DataFrame:
    m = df.sparkSession.createDataFrame([(x,) for x in months], "month string")
    return m.join(df, "month", "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))


def project_acquisition(spark, scenarios: Mapping[str, Mapping[str, float]], inc: DataFrame, months: Sequence[str], p: Params,
                        weeks: int = 20) -> DataFrame:
    """Month sums of cohorts yet to be acquired, each starting in the middle of its month."""
    rows = [(name, m, float(n)) for name, s in scenarios.items() for m, n in s.items()]
    s = spark.createDataFrame(rows, "scenario string, start_month string, new_subs double")
    g = grid(s, "week", 0, weeks - 1)
    mid = F.unix_micros(F.to_timestamp(F.concat(F.col("start_month"), F.lit("-01")))) + F.lit(15 * DAY_US)
    when = F.timestamp_micros(mid + F.col("week") * F.lit(int(p.period_days * DAY_US)))
    g = g.withColumn("month", month_of(when)).join(inc, "week")
    got = g.where(F.col("month").isin(*months)).groupBy("scenario", "month").agg(F.sum(F.col("new_subs") * F.col("inc")).alias("amount"))
    every = s.select("scenario").distinct().withColumn("month", F.explode(F.array(*[F.lit(m) for m in months])))
    return every.join(got, ["scenario", "month"], "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))


def backtest(projected: DataFrame, payments: DataFrame, base: DataFrame, months: Sequence[str], gate: float = 0.25,
             key: str = "sub_id") -> DataFrame:
    """Projected against actual money of the keys that existed at the cut-off."""
    act = payments.join(base.select(key), key, "left_semi").where(month_of("ts").isin(*months)).agg(F.sum("amount").alias("actual"))
    tot = projected.agg(F.sum("amount").alias("predicted"))
    out = tot.withColumn("actual", act.scalar())
    return out.withColumn("error", F.try_divide(F.col("predicted") - F.col("actual"), "actual")).withColumn(
        "ok", F.abs("error") <= gate)
