"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, or under a local temporary one where it is unset and the master is local.

    On a cluster a machine's own folder would lose results without a word, so an unset spark.checkpoint.dir is refused there.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{top}/{name}-{uuid.uuid4().hex}"
