"""Folders for files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new name under spark.checkpoint.dir; a temporary folder only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors see")
        base = f"file://{tempfile.mkdtemp(prefix='kinfold-')}"
    return f"{base.rstrip('/')}/kinfold-{uuid.uuid4().hex}"
