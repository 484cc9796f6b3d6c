"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
SPACE = " \t\n\r\f\v"

# Spellings that mean "no value" in billing payloads.
NULL_TOKENS = ("", "null", "none", "unknown")
# Spellings that mean "no value" in redirect-URL dimensions, after decoding.
GARBAGE_DIMS = ("", "unknown", "none", "null", "{", "nan")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start, end) -> Column:
    return F.unix_micros(col(end)) - F.unix_micros(col(start))


def days_between(start, end) -> Column:
    """Elapsed days as a double."""
    return micros_between(start, end) / F.lit(float(DAY_US))


def whole_days(start, end) -> Column:
    """Elapsed whole 24-hour days, floored (also below zero)."""
    return F.floor(micros_between(start, end) / F.lit(float(DAY_US)))


def periods_between(start, end, period_days: float) -> Column:
    return days_between(start, end) / F.lit(float(period_days))


def period_of_life(start, end, period_days: float) -> Column:
    """Whole periods since entry, never below zero."""
    p = F.floor(whole_days(start, end) / F.lit(float(period_days)))
    return F.greatest(p, F.lit(0).cast("bigint"))


def clip(c, lo=None, hi=None) -> Column:
    """Bound a value; null stays null."""
    x = col(c)
    out = x
    if hi is not None:
        out = F.when(x > F.lit(hi), F.lit(hi)).otherwise(out)
    if lo is not None:
        out = F.when(x < F.lit(lo), F.lit(lo)).otherwise(out)
    return out


def null_token(c) -> Column:
    t = F.trim(col(c), F.lit(SPACE))
    return F.when(F.lower(t).isin(*NULL_TOKENS), F.lit(None)).otherwise(t)


def fill_blank(c, value: str) -> Column:
    """Null or empty becomes `value`."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(value))


def right_closed_bins(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins (e0,e1], (e1,e2], ...; outside is null."""
    x = col(c)
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        cond = (x > lo) & (x <= hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def billday_bin(day) -> Column:
    return right_closed_bins(day, (0, 10, 20, 31), ("d01_10", "d11_20", "d21_31"))


def lookup(c, table: Mapping[str, str], default: str | None = None) -> Column:
    """Value of a small fixed dictionary, `default` for anything else."""
    m = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    hit = F.try_element_at(m, col(c))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def near(c, target: float, tol: float) -> Column:
    return F.abs(col(c) - F.lit(target)) <= F.lit(tol)


def url_dim(c, field: str) -> Column:
    """Decoded, trimmed campaign/ad name; every no-signal spelling becomes (missing)."""
    raw = col(c)
    # '+' is a literal here, and a '%' that starts no valid escape stays as it is
    escaped = F.regexp_replace(F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25"), "\\+", "%2B")
    text = F.trim(F.coalesce(F.try_url_decode(escaped), raw), F.lit(SPACE))
    low = F.lower(text)
    garbage = (
        text.isNull() | low.isin(*GARBAGE_DIMS) | (low == F.lit(field.lower()))
        | (text.startswith("{") & text.endswith("}"))
    )
    return F.when(garbage, F.lit("(missing)")).otherwise(text)


def interval_word(c) -> Column:
    """Billing interval named in a product title; the longest unit is looked for first."""
    n = F.lower(col(c))
    return (
        F.when(n.contains("year") | n.contains("annual"), "year")
        .when(n.contains("month"), "month")
        .when(n.contains("week"), "week")
        .when(n.contains("dail") | n.contains("day"), "day")
    )


# Days in one billing unit.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def add_unit(ts, unit) -> Column:
    """Timestamp plus one billing unit; null when the unit is unknown."""
    days = F.create_map(*[x for k, v in UNIT_DAYS.items() for x in (F.lit(k), F.lit(v))])
    d = F.try_element_at(days, col(unit))
    return F.timestamp_micros(F.unix_micros(col(ts)) + d.cast("bigint") * F.lit(DAY_US))


def monday(ts) -> Column:
    return F.to_date(F.date_trunc("week", col(ts)))


def trial_kind(event_type, amount, trial_event: str, placeholder: float) -> Column:
    """real / placeholder / free for trial rows, null for other rows; keyed on the gross amount."""
    a = F.round(col(amount), 2)
    return F.when(
        col(event_type) == trial_event,
        F.when(a.isNull() | (a <= 0), "free").when(a == F.lit(placeholder), "placeholder").otherwise("real"),
    )


def epoch_chain(*epochs) -> Column:
    """First present epoch-seconds value as a timestamp."""
    return F.coalesce(*[F.timestamp_seconds(col(e)) for e in epochs])


def epoch(ts) -> Column:
    """Timestamp as microseconds, for results compared across engines."""
    return F.unix_micros(col(ts))


def r6(c) -> Column:
    return F.round(col(c), 6)


def long(c) -> Column:
    return col(c).cast("bigint")
