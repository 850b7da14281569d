"""A folder for files that a query writes and reads again: the shared one that the session names, else, on one machine, a local one."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/strandline-scratch"
    return f"{folder}/{name}-{uuid.uuid4().hex}"
