"""Requests to a model and their answers, paired out of a log, in a table or as the log grows.

A log has request_id, kind (request, or response_ and a status), at, and text. Each request comes with the answers that follow it
within a time; one that gets none is told as unanswered, in a stream once the watermark has passed the last moment at which
it could have been answered. Answers without a request are not told. Both forms give the same rows.

Rows without id or time are left out. A request that is logged twice, or answered twice, gives a row for each pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(log: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(request_id, asked_at, answered_at, status, seconds, prompt, response) of a log, which may be a stream; late: how long a stream waits for rows out of order."""
    rows = log.where("request_id IS NOT NULL AND at IS NOT NULL")
    asked = rows.where("kind = 'request'").select(F.col("request_id").alias("_asked"), F.col("at").alias("asked_at"), F.col("text").alias("prompt"))
    told = rows.where(F.col("kind").startswith("response_")).select(F.col("request_id").alias("_told"), F.col("at").alias("answered_at"), F.upper(F.substring("kind", 10, 100)).alias("status"), F.col("text").alias("response"))
    if log.isStreaming:
        asked, told = asked.withWatermark("asked_at", late), told.withWatermark("answered_at", late)
    near = (F.col("_asked") == F.col("_told")) & (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"INTERVAL {within}"))
    seconds = (F.unix_micros("answered_at") - F.unix_micros("asked_at")) / 1e6
    both = asked.join(told, near, "left_outer")
    return both.select(F.col("_asked").alias("request_id"), "asked_at", "answered_at", F.coalesce("status", F.lit("UNANSWERED")).alias("status"), seconds.alias("seconds"), "prompt", "response")
