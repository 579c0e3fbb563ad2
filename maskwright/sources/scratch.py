"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is missing, as in local tests, a folder of this machine is
    made and entered in the session so that every later call uses the same one; on
    a cluster, whose executors wouldn't see it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("maskwright.scratch.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("maskwright.scratch.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/maskwright/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Cuts lineage; the files survive the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
