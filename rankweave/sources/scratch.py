"""A folder for files that a query writes and reads back: shared by driver and executors on a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A path that isn't used yet, below ``spark.checkpoint.dir``; below a temporary folder only in a local session without one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.gettempdir()
    return os.path.join(at.rstrip("/"), f"rankweave-{what}-{uuid.uuid4().hex}")


def written(df, what: str):
    """df as Parquet in a fresh folder, read again: later jobs start from it, and a lost executor costs its tasks only."""
    path, schema = fresh_folder(df.sparkSession, what), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
