"""Reading and writing datasets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenurekit.schema import conform


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def newest_snapshot(df: DataFrame, column: str = "snapshot_date") -> DataFrame:
    """Rows of the latest snapshot. On a dataset partitioned by the column, the subquery prunes the
    scan to one partition."""
    return df.where(F.col(column) == df.agg(F.max(column)).scalar())


def event_scan(df: DataFrame, names: Sequence[str], since: Column, until: Column | None = None,
               apps: Sequence[str] | None = None, key: str = "email", columns: Sequence[str] | None = None) -> DataFrame:
    """Projected, filtered read of an event log with a lower-case key and times as timestamps."""
    out = df.where(F.col("event_type").isin(*names) & (F.col("ts") >= since) & F.col(key).isNotNull())
    if until is not None:
        out = out.where(F.col("ts") < until)
    if apps is not None:
        out = out.where(F.col("app_name").isin(*apps))
    return out.select(F.lower(key).alias(key), *(columns or [c for c in df.columns if c != key]))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV in which only the empty field is null: texts such as NA stay texts."""
    return spark.read.option("header", True).option("nullValue", "").option("emptyValue", "\u0000").schema(schema).csv(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Materialised stage: built once, read back afterwards unless forced. A stage counts as there
    only once its success marker is."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    exists = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
    if force or not exists:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def overwrite_table(df: DataFrame, schema: T.StructType, path: str, allowed: Sequence[str]) -> None:
    """Overwrite one allowed target with rows in the declared layout."""
    if path not in allowed:
        raise ValueError(f"{path} is not an allowed target")
    conform(df, schema).write.mode("overwrite").parquet(path)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out
