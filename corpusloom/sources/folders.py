"""Folders that the driver and every executor see, and how many rows a Python worker gets at once."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


#: Folders that this process named; they are deleted when it ends.
SCRATCH: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below ``spark.checkpoint.dir``, for the time of this process. A folder of this machine stands in only under
    a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-shared")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    SCRATCH[path] = spark
    return path


def exists(spark: SparkSession, path: str) -> bool:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    return to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(to)


def delete(spark: SparkSession, path: str) -> None:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(to, True)


def delete_all() -> None:
    for path, spark in SCRATCH.items():
        with suppress(Exception):  # the session may have ended before
            delete(spark, path)


def small_batches(df: DataFrame, rows: int) -> DataFrame:
    """Have Python workers get at most so many rows at once, since texts and pages may be long. Spark has this setting for a session only, so
    later queries of the session get small batches too; their results are the same."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


atexit.register(delete_all)
