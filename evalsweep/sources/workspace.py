"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def _base(spark: SparkSession) -> str:
    """This application's part of the shared folder that the cluster names.

    Without ``spark.checkpoint.dir`` a temporary folder is used in local mode
    only, until the process ends: on a cluster the executors could not see it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="evalsweep-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/evalsweep-{spark.sparkContext.applicationId}"


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new path for one intermediate table."""
    return f"{_base(spark)}/{purpose}-{uuid.uuid4().hex}"


def remove_work_folders(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it when no result needs them any more."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None):
        path = jvm.org.apache.hadoop.fs.Path(_base(spark))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
