"""Evaluations that arrive as files: each is read once, and the best so far is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)


def running_best(results: DataFrame, by: str, metric: str, item: str) -> DataFrame:
    """The best item and its metric for each ``by``: one row of state a group, however many results arrive."""
    return results.groupBy(by).agg(F.max_by(item, F.struct(metric, item)).alias(item), F.max(metric).alias(metric), F.count(F.lit(1)).alias("seen"))


def start(best: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Into an in-memory table, with a checkpoint, so that a restarted query reads no file twice."""
    return best.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
