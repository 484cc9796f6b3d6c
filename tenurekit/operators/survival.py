"""Direct survival, crash detection and application selection on the step matrix.

Subscriptions are first compressed to counts per (group, whole age, last step); grids of steps are
laid over these counts, never over subscriptions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.functions.exprs import periods_between
from tenurekit.params import Params


def compress(mx: DataFrame, by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Counts of subscriptions per group, last step and observed age in whole periods."""
    per = mx.groupBy(*by, *keep, "sub_id").agg(
        F.max("step_k").alias("max_step"), F.max("weeks_obs").alias("weeks_obs"))
    return per.groupBy(*by, *keep, F.floor("weeks_obs").alias("age"), "max_step").agg(F.count(F.lit(1)).alias("n"))


def grid(df: DataFrame, name: str, lo, hi) -> DataFrame:
    """One row per integer lo..hi; rows with an empty range disappear."""
    lo_c = F.lit(lo).cast("bigint") if not isinstance(lo, Column) else lo
    hi_c = F.lit(hi).cast("bigint") if not isinstance(hi, Column) else hi
    seq = F.when(hi_c >= lo_c, F.sequence(lo_c, hi_c)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(name, F.explode(seq))


def direct_survival(mx: DataFrame, p: Params, by: Sequence[str] = ("app_id",), offset: float = 0.0) -> DataFrame:
    """fact[k]: share with a payment k+1 among subscriptions observed for at least k (+ offset)
    periods; mature[k]: their number."""
    per = mx.groupBy(*by, "sub_id").agg(F.max("step_k").alias("max_step"), F.max("weeks_obs").alias("w"))
    counts = per.groupBy(*by, F.floor(F.col("w") - F.lit(float(offset))).alias("age"), "max_step").agg(
        F.count(F.lit(1)).alias("n"))
    g = grid(counts.where("age >= 1"), "k", 1, F.least(F.col("age"), F.lit(p.hmax).cast("bigint")))
    return g.groupBy(*by, "k").agg(
        F.sum("n").alias("mature"),
        F.sum(F.when(F.col("max_step") >= F.col("k") + 1, F.col("n")).otherwise(0)).alias("alive"),
    ).withColumn("fact", F.col("alive") / F.col("mature"))


def stepwise_retention(mx: DataFrame, p: Params, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """Share of subscriptions at payment k-1 (and old enough) that reached payment k."""
    g = grid(compress(mx, by).where("age >= 2"), "k", 2,
             F.least(F.col("age"), F.col("max_step") + 1, F.lit(p.hmax).cast("bigint")))
    return g.groupBy(*by, "k").agg(
        F.sum("n").alias("at_risk"),
        F.sum(F.when(F.col("max_step") >= F.col("k"), F.col("n")).otherwise(0)).alias("kept"),
    ).withColumn("retention", F.col("kept") / F.col("at_risk"))


def crash_flags(mx: DataFrame, p: Params, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """Groups where some step with enough subscriptions at risk lost more than the allowed share."""
    r = stepwise_retention(mx, p, by)
    worst = r.groupBy(*by).agg(F.min(F.when(F.col("at_risk") >= p.crash_min_risk, F.col("retention"))).alias("worst"))
    return worst.withColumn("worst", F.coalesce("worst", F.lit(1.0))).withColumn("crash", F.col("worst") < p.crash_floor)


def payers(mx: DataFrame, by: Sequence[str] = ("app_id",)) -> DataFrame:
    return mx.groupBy(*by).agg(F.count_distinct("sub_id").alias("payers"))


def select_apps(mx: DataFrame, p: Params) -> DataFrame:
    """Applications with enough paying subscriptions, with their crash flag."""
    return payers(mx).where(F.col("payers") >= p.min_payers).join(crash_flags(mx, p), "app_id", "left").select(
        "app_id", "payers", F.coalesce("worst", F.lit(1.0)).alias("worst"),
        F.coalesce("crash", F.lit(False)).alias("crash"))


def app_facts(mx: DataFrame, p: Params) -> DataFrame:
    """Facts by step of the selected applications, with the crash flag."""
    return direct_survival(mx, p).join(select_apps(mx, p).select("app_id", "crash"), "app_id")


def fact_prefix(facts: DataFrame, min_mature: int, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """Facts from step 1 up to the first step with too few mature subscriptions."""
    w = Window.partitionBy(*by).orderBy("k")
    ok = F.min((F.col("mature") >= min_mature).cast("int")).over(w)
    return facts.withColumn("_ok", (ok == 1) & (F.row_number().over(w) == F.col("k"))).where("_ok").drop("_ok")


def life_table(times: DataFrame, weeks: Sequence[int], period_days: float = 7.0) -> DataFrame:
    """Share of keys alive at each week among keys observed at least that long.

    times: start, death (null while alive) and now."""
    t = times.select(
        F.greatest(periods_between("start", "death", period_days), F.lit(0.0)).alias("life"),
        F.col("death").isNotNull().alias("dead"),
        periods_between("start", "now", period_days).alias("seen"),
        F.explode(F.array(*[F.lit(int(w)).cast("bigint") for w in weeks])).alias("week"))
    alive = ~F.col("dead") | (F.col("life") >= F.col("week"))
    return t.where(F.col("seen") >= F.col("week")).groupBy("week").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(alive).alias("alive")).withColumn(
        "survival", F.col("alive") / F.col("n"))
