"""A folder for tables that are written on the way: in spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path. Without the setting, a session on one machine takes a temporary folder; on a cluster that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-colloquy-")
    return f"{base.rstrip('/')}/colloquy/{name}-{uuid.uuid4().hex}"
