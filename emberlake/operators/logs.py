"""Log list and single records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators.traces import within

PREVIEW = 300


def effective_time() -> Column:
    """A record's own time, or when it was observed if it has none (null or 0)."""
    return F.coalesce(F.nullif(F.col("timestamp"), F.lit(0)), F.col("observed_timestamp"))


def body_preview(body: Column) -> Column:
    """First characters, not bytes."""
    return F.substring(body, 1, PREVIEW)


def search_logs(logs: DataFrame, start: int | None = None, end: int | None = None, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Summaries in the window, by effective time, newest first."""
    out = logs.withColumn("effective_time", effective_time()).filter(within("effective_time", start, end))
    if where is not None:
        out = out.filter(where)
    out = out.select("id", "effective_time", "severity_text", "severity_number", "service_name", "event_name", "trace_id", body_preview(F.col("body")).alias("body_preview"))
    return out if limit is None else out.orderBy(F.desc("effective_time"), "id").limit(limit)


def get_log(logs: DataFrame, log_id: str) -> DataFrame:
    """One full record, or none."""
    return logs.filter(F.col("id") == log_id)
