"""Places for files that a query writes and reads again."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_ours: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and the master is
    this machine; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        found = tempfile.mkdtemp(prefix="stylomill-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder.  What lies there goes when the session's program ends."""
    top = f"{shared_dir(spark).rstrip('/')}/stylomill-{spark.sparkContext.applicationId}"
    if top not in _ours:
        _ours.add(top)
        atexit.register(_swept, spark, top)
    return f"{top}/{uuid.uuid4().hex}-{name}"


def _swept(spark: SparkSession, top: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session was stopped before, and the folder is its owner's to clear
        delete(spark, top)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def lines(spark: SparkSession, name: str, text: str) -> str:
    """The path of a new folder with this text as its one file."""
    path = scratch(spark, name)
    spark.createDataFrame([(x,) for x in text.split("\n")], "value string").coalesce(1).write.text(path)
    return path
