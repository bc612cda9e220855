"""Shared folder for written tables, streaming checkpoints and cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; an error where it is unset.

    There is no fallback: a machine-local folder on a cluster is lost with its machine
    and invisible to the other ones.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return root.rstrip("/")


def ensure_local_root(spark: SparkSession) -> None:
    """For single-machine runs (tests, bench, driver): set a folder of this machine where none is set.

    Only for the masters local and local[...], whose tasks run in the driver's process.
    """
    master = spark.sparkContext.master
    if not spark.conf.get("spark.checkpoint.dir", None) and (master == "local" or master.startswith("local[")):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="barloom-"))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, inside the folder of this application."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote; call it when its results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once and continue from the written table.

    For a reduced frame that the rest of a plan reads several times: it is
    computed once, a lost executor does not recompute it, and the plan behind
    it is gone.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
