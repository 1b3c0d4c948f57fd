"""Queries that drain a table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.sources.fixtures import load
from rankweave.sources.scratch import fresh_folder
from rankweave.streaming.rolling import running

from .base import plain


@plain("stream_running_mean", "SELECT user_id, event_id, row_number() OVER w AS n, round(avg(value) OVER (w ROWS 49 PRECEDING) + 1e-9, 6) AS mean, max(value) OVER w AS best FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _running(s, d):
    """Each user's mean of the last fifty values and best value so far, at every event, from a stream over all of ``events``."""
    events = s.readStream.schema(load(s, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern, as a stream takes a single file by pattern only
    out = fresh_folder(s, "running")
    found = running(events, "user_id", ["ts", "event_id"], "value")
    found.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    rows = s.read.schema(found.schema).parquet(f"{out}/rows")
    return rows.select("user_id", "event_id", "n", F.round(F.col("mean") + 1e-9, 6).alias("mean"), "best")
