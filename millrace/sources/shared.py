"""A new folder that driver and executors share, for what a query writes on its way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the folder of spark.checkpoint.dir; in a local folder only under a local master with the setting unset."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
