"""Stages shared by the registered queries: each is written once per state of its inputs and read back.

A stage is a folder named by its name, its input folder and a fingerprint of the tables there (sizes, numbers of files, times) and of
this package's code, which holds all parameters. In the folder that the cluster names it outlives the application, so the next one
reuses it; a changed table or parameter gives another fingerprint, and the stage of the one before is removed once the new one stands.
On a local master without that folder stages go with the application.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tenurekit.functions.ordered import shared_dir, until_exit, write_once


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def inputs_state(spark: SparkSession, folder: str) -> str:
    """Name, size, number of files and time of every table of a folder, as one digest."""
    fs, p = _fs(spark, folder)
    seen = []
    for s in fs.listStatus(p):
        whole = fs.getContentSummary(s.getPath()) if s.isDirectory() else None
        seen.append((s.getPath().getName(), whole.getLength() if whole else s.getLen(), whole.getFileCount() if whole else 1, s.getModificationTime()))
    return hashlib.md5(repr(sorted(seen)).encode()).hexdigest()[:16]


@lru_cache(maxsize=1)
def code_state() -> str:
    """Digest of this package's modules outside `llm`, with the parameters in them."""
    root = Path(__file__).resolve().parents[1]
    files = sorted(f for f in root.rglob("*.py") if "llm" not in f.relative_to(root).parts)
    return hashlib.md5(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage `name` over `sf_dir`; built by the first query that needs it, whole tables always."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    of = f"stage-{name}-{hashlib.md5(sf_dir.encode()).hexdigest()[:8]}-"
    path = f"{shared_dir(spark)}/{of}{inputs_state(spark, sf_dir)}{code_state()}"
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        # written aside and renamed, so that a stage is whole or not there; of two that race one wins
        made, aside = _fs(spark, f"{shared_dir(spark)}/making-{uuid.uuid4().hex}")
        write_once(build(), aside.toString())
        if not made.rename(aside, p):
            made.delete(aside, True)
        for s in fs.listStatus(p.getParent()):
            if s.getPath().getName().startswith(of) and s.getPath().getName() != p.getName():
                fs.delete(s.getPath(), True)
        if not spark.conf.get("spark.checkpoint.dir", ""):
            until_exit(spark, path)
    return spark.read.parquet(path)
