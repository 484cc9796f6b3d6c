"""Exact percentiles by rank over ranges: no buffer holds the values of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.functions.ordered import Ordered


def percentiles(df: DataFrame, value: str, points: Sequence[float], keys: Sequence[str] = (),
                weight: str | None = None) -> DataFrame:
    """Per key: `q0`, `q1`, ... for the points, `top` (the largest value) and `n` (rows, or their weight).

    Equal values are counted first; running counts over ranges of (key, value) give each value its
    ranks; a point between two ranks is interpolated. Null values have no rank."""
    keys = list(keys)
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.cast("bigint").alias("_n"))
    ranked = Ordered(keys, value).add(counts, running_sum={"_to": F.col("_n")}).withColumn("_k", F.struct(*keys))
    sums = [F.sum("_n").alias("_rows"), F.max(value).alias("_top")]
    if keys == ["_all"]:  # one row, attached as a value: a join on a constant would be a nested loop
        whole = counts.agg(F.struct(*sums)).scalar()
        both = ranked.withColumn("_w", whole).withColumns({"_rows": F.col("_w._rows"), "_top": F.col("_w._top")})
    else:
        both = ranked.join(counts.groupBy(F.struct(*keys).alias("_k")).agg(*sums), "_k")
    at = [F.lit(float(q)) * (F.col("_rows") - 1) for q in points]
    found = []
    for i, a in enumerate(at):
        found += [F.min(F.when(F.col("_to") > F.floor(a), F.col(value))).alias(f"_lo{i}"),
                  F.min(F.when(F.col("_to") > F.ceil(a), F.col(value))).alias(f"_hi{i}")]
    g = both.groupBy("_k", "_rows", "_top").agg(*found)
    q = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (a - F.floor(a))).alias(f"q{i}") for i, a in enumerate(at)]
    return g.select(*[F.col("_k")[k].alias(k) for k in keys if k != "_all"], *q, F.col("_top").alias("top"), F.col("_rows").alias("n"))
