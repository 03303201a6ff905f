"""The folder that a cluster's driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """This application's path for ``name`` under ``spark.checkpoint.dir``; it is written over when written again.

    Where that is unset, a session in one process has a temporary folder; on a cluster a RuntimeError is raised.
    """
    top, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if top is None:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        top = tempfile.gettempdir()
    return f"{top.rstrip('/')}/{spark.sparkContext.applicationId}-{name}"
