"""Declared layouts, column checks and a schema-conforming overwrite."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_PREDICTIONS = T.StructType([
    T.StructField("cohort_date", T.DateType(), False), T.StructField("funnel", T.StringType(), False),
    T.StructField("utm_source", T.StringType(), False), T.StructField("n_trial", T.LongType(), False),
    T.StructField("n_base_payer", T.LongType(), False), T.StructField("payer_rate", T.DoubleType(), True),
    T.StructField("low_n", T.BooleanType(), True), T.StructField("ltv_current", T.DoubleType(), True),
])


def require_columns(df: DataFrame, needed: Sequence[str], what: str = "input") -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df


def schema_diff(df: DataFrame, schema: T.StructType) -> list[str]:
    """Differences between a DataFrame and a declared layout, as readable lines."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in schema.fields}
    out = [f"missing {c}" for c in want if c not in have] + [f"extra {c}" for c in have if c not in want]
    return out + [f"{c} is {have[c]}, not {want[c]}" for c in want if c in have and have[c] != want[c]]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in declared order and type; missing or extra columns stop the job."""
    bad = [x for x in schema_diff(df, schema) if x.startswith(("missing", "extra"))]
    if bad:
        raise ValueError("; ".join(bad))
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def remap(df: DataFrame, layout: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Result columns under another layout: new name -> (old name, type)."""
    return df.select(*[F.col(f"`{old}`").cast(t).alias(new) for new, (old, t) in layout.items()])
