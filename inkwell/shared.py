"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only in a local session where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="inkwell")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
