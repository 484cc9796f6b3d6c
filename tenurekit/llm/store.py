"""Tables written to the folder that all executors share, which cut lineage and survive a lost executor."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tenurekit.functions import workers

BATCH_ROWS = 500


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`. Only a local master may lack the setting; it then gets a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None, compression: str = "zstd") -> DataFrame:
    """`df` as a Parquet table, read back with the same schema."""
    path = folder or new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a table made by `written` once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.fullmatch(r".*-[0-9a-f]{32}", folder):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """What queries need before they run: workers that can import this package, and batches for Python that
    suit long texts (BATCH_ROWS, unless the session has a limit of its own)."""
    workers.ship(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":  # Spark's default
        spark.conf.set(setting, str(BATCH_ROWS))
