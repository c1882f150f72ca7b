"""Intermediate tables in the folder that all executors share.

A plan that needs its lineage cut, or a result read more than once, is written
as Parquet below ``spark.checkpoint.dir``. A lost executor then costs a reread,
never a recomputation from the start.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set (tests), a new one that is removed at exit.

    On a cluster each machine would write to a folder of its own, so the setting must be there.
    """
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    if not _own:
        local = tempfile.mkdtemp(prefix=f"tessera-{os.getpid()}-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        _own.append(f"file://{local}")
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
