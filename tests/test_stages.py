"""Stages: reused while inputs are the same, built again when they change."""
from __future__ import annotations

import os

import pytest

from tenurekit.plans import stages


@pytest.fixture
def shared(tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "shared_dir", lambda spark: str(tmp_path / "shared"))
    return tmp_path / "shared"


def test_a_stage_follows_its_inputs(spark, tmp_path, shared, monkeypatch):
    d = tmp_path / "tables"
    spark.range(5).write.parquet(f"{d}/one.parquet")
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(f"{d}/one.parquet").selectExpr("id * 2 AS x")

    get = lambda: sorted(r.x for r in stages.staged(spark, str(d), "twice", build).collect())
    assert get() == get() == [0, 2, 4, 6, 8] and len(built) == 1
    spark.range(7).write.mode("overwrite").parquet(f"{d}/one.parquet")
    assert get() == [0, 2, 4, 6, 8, 10, 12] and len(built) == 2
    assert sum(f.startswith("stage-twice") for f in os.listdir(shared)) == 1  # the old one is gone
    spark.range(3).write.parquet(f"{d}/another.parquet")  # any table of the folder counts
    get()
    monkeypatch.setattr(stages, "code_state", lambda: "changed")
    get()
    assert len(built) == 4 and not any(f.startswith("making") for f in os.listdir(shared))


def test_a_failed_stage_leaves_nothing(spark, tmp_path, shared):
    d = tmp_path / "tables"
    spark.range(5).write.parquet(f"{d}/one.parquet")
    with pytest.raises(Exception):
        stages.staged(spark, str(d), "bad", lambda: spark.range(3).selectExpr("raise_error('no') AS x"))
    assert not os.path.exists(shared) or not any(f.startswith("stage-bad") for f in os.listdir(shared))
    assert stages.staged(spark, str(d), "bad", lambda: spark.range(3).toDF("x")).count() == 3
