"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Partition counts and broadcast joins are left to adaptive execution: it coalesces small shuffles, splits skewed
#: join partitions and only broadcasts a side whose measured size is under the threshold.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "snappy",
    # the JVM does not compile methods over 8000 bytes: a wide cleaning projection would run interpreted
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def open_writers(spark: SparkSession, files: int = 16):
    """For writes whose rows were dealt out by their partition columns: a task meets few partitions, so it keeps a file of each
    open instead of sorting its full rows.  A task that meets more than ``files`` sorts the rest."""
    return _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(files))


def passing_shuffles(spark: SparkSession):
    """For writes: their shuffle files go as soon as the write is done, as nothing reads them again.  Otherwise they stay until
    the driver happens to collect its garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def share_code(spark: SparkSession) -> None:
    """Python workers find this package where the driver does; a cluster without a shared installation ships it with
    ``--py-files``."""
    root, known = str(Path(__file__).parents[1]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else a temp folder in local mode only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="tillworks-")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder; never reused, so nothing has to be cleared first."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later steps do not compute it again, nor does a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
