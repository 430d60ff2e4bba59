"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path that nobody else uses, below ``spark.checkpoint.dir``, or for a local master without one in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lexiprint-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
