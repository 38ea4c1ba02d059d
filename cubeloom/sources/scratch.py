"""A folder that driver and executors share, for rollup stores of demonstrations and tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; in local mode without that setting, a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="cubeloom-store-"))
    return f"{base.rstrip('/')}/{sc.applicationId}/{name}-{uuid.uuid4().hex[:8]}"
