"""Logistic survival models on counted feature cells (Spark ML).

Training rows are first counted per feature combination, so the solver sees weighted cells. The
penalty equals that of an L2 model with C = 1: one over the total weight, on raw coefficients.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurekit.functions.ranks import percentiles
from tenurekit.functions.exprs import clip
from tenurekit.functions.ordered import cut
from tenurekit.operators import hazard as H
from tenurekit.params import Params

CATS = ("step_bin", "geo", "media_source", "attribution_source", "plan_interval", "cohort_month")
NUMS = ("billing_day_of_month", "trial_days")
LEVERS = ("geo", "media_source", "attribution_source", "plan_interval", "cohort_month", "billing_day_of_month", "trial_days")


def top_categories(df: DataFrame, columns: Sequence[str], n: int = 30) -> DataFrame:
    """The n most frequent values per column (ties by value): at most n rows a column."""
    out = None
    for c in columns:
        t = df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null")
        t = t.orderBy(F.desc("n"), "value").limit(n).select(F.lit(c).alias("lever"), "value", "n")
        out = t if out is None else out.unionByName(t)
    return out


def collapse(df: DataFrame, tops: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values outside the kept lists become `other`. The lists are short, so they are broadcast."""
    for c in columns:
        keep = tops.where(F.col("lever") == c).select(F.col("value").alias(c), F.lit(True).alias("_k"))
        df = df.join(F.broadcast(keep), c, "left").withColumn(c, F.when(F.col("_k"), F.col(c)).otherwise("other")).drop("_k")
    return df


def features(mx: DataFrame, tops: DataFrame, p: Params) -> DataFrame:
    """Step as a category, rare levers folded, missing trial length as -1."""
    out = collapse(mx, tops, ("geo", "media_source", "attribution_source"))
    return out.withColumn("step_bin", F.least("step_k", F.lit(p.hmax)).cast("string")).withColumn(
        "trial_days", F.coalesce("trial_days", F.lit(-1)).cast("double")).withColumn(
        "billing_day_of_month", F.col("billing_day_of_month").cast("double"))


@dataclass
class Model:
    pipeline: PipelineModel
    tops: DataFrame


def fit(mx: DataFrame, p: Params, weight: Column | None = None, min_frequency: int = 50, cats: Sequence[str] = CATS) -> Model:
    """P(survive the step) from levers, on steps old enough to be judged. `weight` gives a row its weight."""
    tops = cut(top_categories(mx, ("geo", "media_source", "attribution_source")))
    z = features(mx, tops, p).where(F.col("weeks_obs") >= F.col("step_k") + 1)
    z = z.withColumn("_w", F.lit(1.0) if weight is None else weight)
    return Model(_fit_cells(_cells(z, cats), min_frequency, cats), tops)


def _cells(z: DataFrame, cats: Sequence[str]) -> DataFrame:
    return cut(z.groupBy(*cats, *NUMS, F.col("survived").cast("double").alias("label")).agg(F.sum("_w").alias("w"), F.count(F.lit(1)).alias("n")))


def _fit_cells(cells: DataFrame, min_frequency: int, cats: Sequence[str], nums: Sequence[str] = NUMS, penalty: float = 1.0) -> PipelineModel:
    total = cells.agg(F.sum("w")).first()[0]
    train = fold_rare(cells, min_frequency, cats)
    stages = [StringIndexer(inputCols=list(cats), outputCols=[f"{c}_i" for c in cats], handleInvalid="keep"),
              OneHotEncoder(inputCols=[f"{c}_i" for c in cats], outputCols=[f"{c}_v" for c in cats], dropLast=False, handleInvalid="keep"),
              VectorAssembler(inputCols=[*[f"{c}_v" for c in cats], *nums], outputCol="x"),
              LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", maxIter=1000, tol=1e-10, regParam=penalty / total, standardization=False)]
    return Pipeline(stages=stages).fit(train)


def fold_rare(cells: DataFrame, min_frequency: int, cats: Sequence[str]) -> DataFrame:
    """Categories with few rows (column n) become `infrequent`."""
    train = cells
    for c in cats:
        rare = cells.groupBy(c).agg(F.sum("n").alias("_f")).where(F.col("_f") < min_frequency).select(c, F.lit(True).alias("_r"))
        train = train.join(rare, c, "left").withColumn(c, F.when(F.col("_r"), "infrequent").otherwise(F.col(c))).drop("_r")
    return train


def score_equations(cells: DataFrame, model: PipelineModel, cats: Sequence[str] = CATS, nums: Sequence[str] = NUMS, min_frequency: int = 50,
                    penalty: float = 1.0) -> DataFrame:
    """Per feature: rows, survivors, and what the model says they are: expected survivors plus the penalty's share (the weight itself).
    The two are equal where the fit is the optimum, and only there. cells: features, label, w, n."""
    out = vector_to_array("probability")[1]
    scored = model.transform(fold_rare(cells, min_frequency, cats)).select(*cats, *nums, "label", "w", "n", "x", out.alias("_p"))
    flat = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category"), F.lit(1.0).alias("x")) for c in cats]
    flat += [F.struct(F.lit(c).alias("feature"), F.lit("value").alias("category"), F.col(c).cast("double").alias("x")) for c in nums]
    part = scored.withColumn("_f", F.explode(F.array(*flat))).select("_f.*", "label", "w", "n", "_p")
    w = F.col("w") * F.col("x")
    sums = part.groupBy("feature", "category").agg(F.sum("n").alias("n"), F.sum(w * F.col("label")).alias("survivors"), F.sum(w * F.col("_p")).alias("expected"))
    return sums.join(weights(model, scored), ["feature", "category"]).withColumn("fitted", F.col("expected") + F.lit(float(penalty)) * F.col("weight")).drop("expected")


def weights(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """(feature, category, weight) of a fitted pipeline; a numeric feature has the one category `value`. As many rows as features."""
    names = [a for kind in scored.schema["x"].metadata["ml_attr"]["attrs"].values() for a in kind]
    rows = []
    for a in names:
        feature, _, category = a["name"].partition("_v_")
        rows.append((feature, category or "value", float(model.stages[-1].coefficients[a["idx"]])))
    return scored.sparkSession.createDataFrame(rows, "feature string, category string, weight double")


def survive(model: PipelineModel, cells: DataFrame, name: str = "p") -> DataFrame:
    """Adds the predicted probability to feature cells."""
    out = model.transform(cells)
    keep = [c for c in cells.columns]
    return out.select(*keep, vector_to_array("probability")[1].alias(name))


def _combos(mx: DataFrame, model: Model, p: Params, by: Sequence[str]) -> DataFrame:
    z = features(mx, model.tops, p)
    per = z.groupBy(*by, "sub_id").agg(*[F.min_by(c, "step_k").alias(c) for c in LEVERS])
    return per.groupBy(*by, *LEVERS).agg(F.count(F.lit(1)).alias("w"))


def risk_grid(combos: DataFrame, model: Model, p: Params, length: int | None = None) -> DataFrame:
    """Predicted risk of each combination at every step."""
    steps = F.sequence(F.lit(1).cast("bigint"), F.lit(length or p.hmax).cast("bigint"))
    g = combos.withColumn("step_k", F.explode(steps)).withColumn("step_bin", F.least("step_k", F.lit(p.hmax)).cast("string"))
    return survive(model.pipeline, g).withColumn("risk", 1 - F.col("p")).drop("p")


def _ratio(per: DataFrame, p: Params, by: Sequence[str], weeks: Sequence[int]) -> DataFrame:
    """Shrunk ratio from per-step observed (o), expected (e) and size (n)."""
    z = per.withColumn("weeks", F.explode(F.array(*[F.lit(int(w)).cast("bigint") for w in weeks]))).where(F.col("step_k") <= F.col("weeks"))
    return H._shrunk(z, F.col("o"), F.col("e"), p, [*by, "weeks"])


def predict(mx: DataFrame, model: Model, p: Params, by: Sequence[str] = ("app_id",), weeks: Sequence[int] = (4,)) -> DataFrame:
    """Survival curves of the plain logistic model with the group's ratio on top."""
    z = features(mx, model.tops, p).where(F.col("weeks_obs") >= F.col("step_k") + 1)
    obs = z.groupBy(*by, "step_k", *CATS, *NUMS).agg(F.count(F.lit(1)).alias("n"), F.sum("died").alias("d"))
    obs = survive(model.pipeline, obs)
    per = obs.groupBy(*by, "step_k").agg((F.sum("d") / F.sum("n")).alias("o"), (F.sum(F.col("n") * (1 - F.col("p"))) / F.sum("n")).alias("e"), F.sum("n").alias("n"))
    hr = _ratio(per, p, by, weeks)
    g = risk_grid(_combos(mx, model, p, by), model, p)
    curve = g.groupBy(*by, *LEVERS, "w").agg(F.map_from_entries(F.collect_list(F.struct("step_k", "risk"))).alias("_hm"))
    c = curve.join(hr, [*by])
    return _curves(c, F.col("hr"), p, [*by, "weeks"])


def _curves(df: DataFrame, scale: Column, p: Params, by: Sequence[str]) -> DataFrame:
    """Weighted mean of running products; each row carries its risks as a map of at most hmax steps."""
    steps = F.sequence(F.lit(1).cast("bigint"), F.lit(p.hmax).cast("bigint"))
    df = df.withColumn("_sc", scale)

    def alive(k):
        return 1 - clip(F.try_element_at("_hm", k) * F.col("_sc"), *p.hazard_clip)

    init = F.struct(F.lit(1.0).alias("s"), F.array().cast("array<double>").alias("a"))
    run = F.aggregate(steps, init, lambda acc, k: F.struct((acc["s"] * alive(k)).alias("s"), F.concat(acc["a"], F.array(acc["s"] * alive(k))).alias("a")))
    rows = df.select(*by, "w", F.posexplode(run["a"]).alias("_i", "_s"))
    return rows.groupBy(*by, (F.col("_i") + 1).cast("bigint").alias("k")).agg((F.sum(F.col("w") * F.col("_s")) / F.sum("w")).alias("s"))


def relative_risk(mx: DataFrame, model: Model, p: Params, version: int, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """Risk of a group's lever mix over the portfolio's, one number per group.

    Version 1 weighs the portfolio by training rows and averages all steps; version 2 weighs it by
    subscriptions and averages the first eight."""
    if version == 1:
        z = features(mx, model.tops, p).where(F.col("weeks_obs") >= F.col("step_k") + 1)
        port = z.groupBy(*LEVERS).agg(F.count(F.lit(1)).alias("w"))
    else:
        port = features(mx, model.tops, p).groupBy("sub_id").agg(
            *[F.min_by(c, "step_k").alias(c) for c in LEVERS]).groupBy(*LEVERS).agg(F.count(F.lit(1)).alias("w"))
    last = p.hmax if version == 1 else 8
    base = risk_grid(port, model, p, last).groupBy("step_k").agg((F.sum(F.col("w") * F.col("risk")) / F.sum("w")).alias("pr"))
    own = risk_grid(_combos(mx, model, p, by), model, p, last).groupBy(*by, "step_k").agg((F.sum(F.col("w") * F.col("risk")) / F.sum("w")).alias("ar"))
    return own.join(base, "step_k").groupBy(*by).agg(clip(F.avg(F.col("ar") / F.col("pr")), *p.clip).alias("rr"))


def hybrid_predict(mx: DataFrame, model: Model, p: Params, version: int, by: Sequence[str] = ("app_id",), weeks: Sequence[int] = (4,)) -> DataFrame:
    """Portfolio hazard x relative risk of the lever mix x observed ratio."""
    h = cut(H.portfolio_hazard(mx, p))
    rr = cut(relative_risk(mx, model, p, version, by))
    obs = mx.where(F.col("weeks_obs") >= F.col("step_k") + 1).groupBy(*by, "step_k").agg(
        F.avg(F.col("died").cast("double")).alias("o"), F.count(F.lit(1)).alias("n"))
    obs = obs.join(rr, [*by]).join(h.select("step_k", "h"), "step_k", "left").withColumn("e", clip(F.col("h") * F.col("rr"), *p.hazard_clip))
    hr = _ratio(obs, p, by, weeks).join(rr, [*by]).withColumn("w", F.lit(1.0)).withColumn("_hm", H.hazard_array(h, p.hmax))
    return _curves(hr, F.col("hr") * F.col("rr"), p, [*by, "weeks"])


def equal_app_weight(mx: DataFrame) -> DataFrame:
    """Adds app_weight, so that every application carries the same total weight."""
    n = mx.groupBy("app_id").agg(F.count(F.lit(1)).alias("_n"))
    return mx.join(n, "app_id").withColumn("app_weight", 1.0 / F.col("_n")).drop("_n")


@dataclass
class Baseline:
    scores: DataFrame
    calibration: DataFrame
    steps: DataFrame


def baseline(mx: DataFrame, p: Params, seed: int = 42, cap: int = 13) -> Baseline:
    """Feature baseline: held-out quarter, AUC, log-loss and Brier score, calibration by decile, and the
    weight of each step category."""
    tops = cut(top_categories(mx, ("geo", "media_source", "attribution_source", "app_id")))
    z = collapse(features(mx, tops, p), tops, ("app_id",))
    label = F.when(F.col("step_k") >= cap, f"{cap}+").otherwise(F.col("step_k").cast("string"))
    z = z.withColumn("step_bin", label).withColumn("_w", F.lit(1.0)).withColumn(
        "_test", F.pmod(F.xxhash64(F.lit(seed), "sub_id", "step_k"), F.lit(4)) == 0)
    cats = (*CATS, "app_id")
    model = _fit_cells(_cells(z.where("not _test"), cats), 50, cats)
    raw = model.transform(_cells(z.where("_test"), cats))
    t = cut(raw.select("label", "w", vector_to_array("probability")[1].alias("p")))
    auc = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", weightCol="w").evaluate(t)
    safe = clip("p", 1e-15, 1 - 1e-15)
    ll = -(F.col("label") * F.ln(safe) + (1 - F.col("label")) * F.ln(1 - safe))
    w = F.col("w")
    scores = t.agg((F.sum(w * ll) / F.sum(w)).alias("log_loss"), (F.sum(w * F.pow(F.col("p") - F.col("label"), 2)) / F.sum(w)).alias("brier"),
                   (F.sum(w * F.col("label")) / F.sum(w)).alias("base_rate"), F.sum(w).cast("bigint").alias("n")).withColumn("auc", F.lit(auc))
    names = raw.schema["x"].metadata["ml_attr"]["attrs"]
    flat = [(a["name"], float(model.stages[-1].coefficients[a["idx"]])) for kind in names.values() for a in kind]
    steps = mx.sparkSession.createDataFrame([(n.split("_v_", 1)[1], c) for n, c in flat if n.startswith("step_bin_v_")], "step_bin string, coefficient double")
    return Baseline(scores, calibration(t), steps)


def calibration(t: DataFrame, bins: int = 10) -> DataFrame:
    """Predicted against real share per quantile bin of the prediction (label, p, w)."""
    points = [i / bins for i in range(1, bins)]
    edges = percentiles(t, "p", points, weight="w").select(F.array(*[f"q{i}" for i in range(bins - 1)])).scalar()
    b = t.withColumn("_e", edges).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col("p"))).cast("bigint"))
    w = F.col("w")
    return b.groupBy("bin").agg((F.sum(w * F.col("p")) / F.sum(w)).alias("pred"), (F.sum(w * F.col("label")) / F.sum(w)).alias("real"), F.sum(w).cast("bigint").alias("n"))
