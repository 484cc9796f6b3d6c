"""Sources, sinks and layouts."""
import pytest
from pyspark.sql import types as T

from tenurekit import schema as X
from tenurekit.sources import io

S = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_conform_casts_and_orders(spark):
    df = spark.createDataFrame([("x", 1)], "b string, a int")
    out = X.conform(df, S)
    assert out.columns == ["a", "b"] and dict(out.dtypes)["a"] == "bigint"
    with pytest.raises(ValueError, match="missing"):
        X.conform(df.drop("a"), S)
    with pytest.raises(ValueError, match="extra"):
        X.conform(df.withColumn("c", df.a), S)
    assert X.schema_diff(df, S) == ["a is int, not bigint"]


def test_only_allowed_targets(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], S)
    with pytest.raises(ValueError, match="not an allowed target"):
        io.overwrite_table(df, S, str(tmp_path / "no"), [str(tmp_path / "yes")])
    io.overwrite_table(df, S, str(tmp_path / "yes"), [str(tmp_path / "yes")])
    assert spark.read.parquet(str(tmp_path / "yes")).count() == 1


def test_csv_keeps_na(spark, tmp_path):
    df = spark.createDataFrame([(1, "NA"), (2, None)], S)
    io.write_csv(df, str(tmp_path / "c"))
    assert [r["b"] for r in io.read_csv(spark, str(tmp_path / "c"), S).orderBy("a").collect()] == ["NA", None]


def test_stage_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, "x")], S)

    path = str(tmp_path / "s")
    io.stage(spark, path, build)
    io.stage(spark, path, build)
    assert len(calls) == 1
    io.stage(spark, path, build, force=True)
    assert len(calls) == 2


def test_newest_snapshot_prunes(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01")], "a int, snapshot_date string").selectExpr("a", "cast(snapshot_date as date) snapshot_date")
    io.write_parquet(df, str(tmp_path / "p"), ["snapshot_date"])
    assert [r["a"] for r in io.newest_snapshot(spark.read.parquet(str(tmp_path / "p"))).collect()] == [2]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="lacks columns"):
        X.require_columns(spark.range(1), ["id", "x"])
