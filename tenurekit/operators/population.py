"""The denominator: one row per key with entry date, cohort, levers, age and revenue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurekit.functions.exprs import fill_blank, null_token, period_of_life, url_dim
from tenurekit.operators.ladder import first_values, snapshot
from tenurekit.operators.revenue import BASE, TRIAL
from tenurekit.params import Params

# Spellings of a first funnel that count as organic.
ORGANIC = ("", "unknown", "none")


def build_population(events: DataFrame, p: Params, window_start: str | None = None,
                     now: Column | None = None, cohort_unit: str = "week") -> DataFrame:
    """Everyone who started a trial of any kind or paid for the base plan. Levers are the first
    non-null values of the entry events; the start window applies to the true first date."""
    entry = events.where(F.col("event_type").isin(TRIAL, BASE))
    cols = ["email", "funnel_name", "country", "utm_source", "campaign_name", "ad_name"]
    first = entry.groupBy("session_id").agg(F.min("ts").alias("first_date"))
    pop = first.join(first_values(entry, "session_id", cols), "session_id")
    pop = pop.select(
        "session_id", "email", "first_date", fill_blank("funnel_name", "unknown").alias("first_funnel"),
        fill_blank("country", "(none)").alias("geo"), fill_blank("utm_source", "(missing)").alias("utm_source"),
        url_dim("campaign_name", "campaign_name").alias("campaign_name"), url_dim("ad_name", "ad_name").alias("ad_name"))
    if window_start is not None:
        pop = pop.where(F.col("first_date") >= F.lit(window_start).cast("timestamp"))
    pop = pop.withColumn("snapshot_now", snapshot(events) if now is None else now)
    return pop.withColumn("age_weeks_now", period_of_life("first_date", "snapshot_now", p.period_days)).withColumn(
        "cohort_date", F.to_date(F.date_trunc(cohort_unit, "first_date")))


def attach_revenue(pop: DataFrame, revenue: DataFrame) -> DataFrame:
    """Revenue onto the population; people without revenue stay, with zeros."""
    money, flags = ["trial_net", "base_net", "ups_net", "total_net"], ["has_ups", "has_paid_trial"]
    out = pop.join(revenue.select("session_id", *money, *flags), "session_id", "left")
    out = out.fillna(0.0, money).fillna(False, flags)
    return out.withColumn("has_base", F.col("base_net") > 0).withColumn("paid_anything", F.col("total_net") > 0)


def denominators(pop: DataFrame, by: Sequence[str] = (), total: str = "total_net") -> DataFrame:
    return pop.groupBy(*by).agg(F.count(F.lit(1)).alias("n_attributed"), F.count_if(F.col(total) > 0).alias("n_payers"))


def mature(pop: DataFrame, min_age: int) -> DataFrame:
    return pop.where(F.col("age_weeks_now") >= min_age)


def maturity_report(pop: DataFrame, ages: Sequence[int]) -> DataFrame:
    """Members before and after each age floor."""
    per = pop.groupBy("age_weeks_now").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("min_age", F.explode(F.array(*[F.lit(a).cast("bigint") for a in ages])))
    return per.groupBy("min_age").agg(F.sum("n").alias("n_before"), F.sum(
        F.when(F.col("age_weeks_now") >= F.col("min_age"), F.col("n")).otherwise(0)).alias("n_after"))


def funnel_class(c: str, whitelist: Sequence[str]) -> Column:
    """whitelist, organic or other."""
    x = F.col(c)
    organic = x.isNull() | F.lower(F.trim(x)).isin(*ORGANIC)
    return F.when(x.isin(*whitelist), "whitelist").when(organic, "organic").otherwise("other")


def whitelist_population(people: DataFrame, c: str, whitelist: Sequence[str]) -> DataFrame:
    return people.withColumn("funnel_class", funnel_class(c, whitelist)).where("funnel_class <> 'other'")


def funnel_report(people: DataFrame, c: str, whitelist: Sequence[str]) -> DataFrame:
    """People kept and dropped per funnel class."""
    g = people.withColumn("funnel_class", funnel_class(c, whitelist)).groupBy("funnel_class").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("kept", F.col("funnel_class") != "other")


def identity_map(first: DataFrame, second: DataFrame) -> DataFrame:
    """customer id -> lower-case e-mail from two providers; on a clash the first provider wins, then
    the smallest address."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    both = both.where("customer_user_id is not null and email is not null").withColumn("email", F.lower("email"))
    return both.groupBy("customer_user_id").agg(F.min_by("email", F.struct("_p", "email")).alias("email"))


def clean_token(c: str) -> Column:
    return null_token(c)
