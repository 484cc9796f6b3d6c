"""What was known at several points (cut-off dates, numbers of visible periods), without a copy of the matrix per point.

A row's part in a count begins at the first point that satisfies a condition and, for some views, ends before a later one.
Rows are counted once into a triangular cube, by group, step, levers and these two places. A count at a point is then a sum over all
cells that began up to it less those that ended: a difference array over the points, summed up along them. The steps of a key are
numbered from 1, so a key is known where its first step is, and at least m steps of it are known where step m is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.functions.exprs import periods_between
from tenurekit.operators import hazard as H
from tenurekit.params import Params


def first_point(points: Sequence[Column], ok: Callable[[Column], Column]) -> Column:
    """Place of the first of the ascending points at which `ok` holds, for a condition that stays true; their number if none."""
    return sum((F.when(ok(x), 0).otherwise(1) for x in points), F.lit(0))


def at_points(cells: DataFrame, points: Sequence[Column], name: str, by: Sequence[str], sums: Sequence[str], start: str,
              until: str | None = None) -> DataFrame:
    """Sums per `by` and point (column `name`) over the cells that have begun (place in `start`) and not ended (place in `until`).

    Points at which the first of the sums is zero have no row. Only cells that begin or end are written, never one per point."""
    last = len(points)
    cells = cells.where(F.col(start) < last)
    if until is None:
        steps = cells.groupBy(*by, F.col(start).alias("_at")).agg(*[F.sum(x).alias(x) for x in sums])
    else:
        both = F.array(F.struct(F.col(start).alias("_at"), F.lit(1).alias("_sign")), F.struct(F.col(until).alias("_at"), F.lit(-1).alias("_sign")))
        cells = cells.where(F.col(start) < F.col(until)).groupBy(*by, start, until).agg(*[F.sum(x).alias(x) for x in sums])
        steps = cells.withColumn("_e", F.explode(both)).where(F.col("_e._at") < last)
        steps = steps.groupBy(*by, F.col("_e._at").alias("_at")).agg(*[F.sum(F.col(x) * F.col("_e._sign")).alias(x) for x in sums])
    along = Window.partitionBy(*by).orderBy("_at")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = steps.select(*by, "_at", F.lead("_at", 1, last).over(along).alias("_next"), *[F.sum(x).over(upto).alias(x) for x in sums])
    held = run.where(F.col(sums[0]) > 0).withColumn("_p", F.explode(F.sequence(F.col("_at"), F.col("_next") - 1)))
    return held.select(*by, F.element_at(F.array(*points), F.col("_p") + 1).alias(name), *sums)


def in_force(cells: DataFrame, points: Sequence[Column], name: str, by: Sequence[str], sums: Sequence[str], start: str, until: str) -> DataFrame:
    """Sums per `by` and point (column `name`) over the cells whose places `start` up to before `until` hold the point.

    For money, which a difference array would leave with rounding errors: parts are only ever added. Rows are summed per pair of
    places first, so that a group has at most half the square of the number of points, whatever it holds."""
    cells = cells.where(F.col(start) < F.col(until)).groupBy(*by, start, until).agg(*[F.sum(x).alias(x) for x in sums])
    held = cells.withColumn("_p", F.explode(F.sequence(F.col(start), F.col(until) - 1)))
    return held.groupBy(*by, F.element_at(F.array(*points), F.col("_p") + 1).alias(name)).agg(*[F.sum(x).alias(x) for x in sums])


def first_levers(p: Params) -> list[Column]:
    """Lever columns of a cube as a key's first step has them."""
    return [F.col("billday_first" if lv == "billday_bin" else lv).alias(lv) for lv in p.levers]


def _levers(p: Params) -> list[str]:
    return [*p.levers, *(["billday_first"] if "billday_bin" in p.levers else [])]


def _with_first(mx: DataFrame, p: Params) -> DataFrame:
    first = mx.groupBy("sub_id").agg(F.min("pay_ts").alias("_first"))
    return H.lever_columns(mx, p).join(first, "sub_id")


def calendar_cube(mx: DataFrame, cutoffs: Sequence[Column], p: Params, by: Sequence[str]) -> DataFrame:
    """Rows and deaths by group, step, levers and the places of the cut-offs at which a row is first known (`seen`), has an age of its
    step (`old`) and of one step more (`older`)."""
    age = lambda t: periods_between(F.col("_first"), t, p.period_days)
    places = {
        "seen": first_point(cutoffs, lambda t: F.col("pay_ts") < t),
        "old": first_point(cutoffs, lambda t: (F.col("pay_ts") < t) & (age(t) >= F.col("step_k"))),
        "older": first_point(cutoffs, lambda t: (F.col("pay_ts") < t) & (age(t) >= F.col("step_k") + 1)),
    }
    rows = _with_first(mx, p).withColumns(places).where(F.col("seen") < len(cutoffs))
    return rows.groupBy(*by, "step_k", *_levers(p), *places).agg(
        F.count(F.lit(1)).alias("n"), F.sum("survived").alias("surv"), F.sum("died").alias("died"))


def visible_cube(mx: DataFrame, weeks: Sequence[int], p: Params, by: Sequence[str]) -> DataFrame:
    """Rows and deaths by group, step, levers and the places of the numbers of visible periods from which a row is seen (it was paid
    by then) up to which its key is old enough (`seen`, `gone`)."""
    points = [F.lit(int(w)).cast("bigint") for w in weeks]
    paid = periods_between("_first", "pay_ts", p.period_days)
    places = {"seen": first_point(points, lambda w: paid < w), "gone": first_point(points, lambda w: F.col("weeks_obs") < w)}
    rows = _with_first(mx, p).withColumns(places).where("seen < gone")
    return rows.groupBy(*by, "step_k", *_levers(p), *places).agg(F.count(F.lit(1)).alias("n"), F.sum("died").alias("died"))
