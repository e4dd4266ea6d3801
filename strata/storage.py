"""Shared scratch space for written tables, stream logs and checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine without that setting gets a temporary folder, which
    goes with the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="strata-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


_SESSION = uuid.uuid4().hex


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strata/{_SESSION}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that this process wrote by `fresh_dir`: for the end of a job, when its
    results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/strata/{_SESSION}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once and cut its lineage: written to the shared folder and read back, so
    that later stages neither repeat the work nor lose it with an executor."""
    path = fresh_dir(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
