"""Structured Streaming ingest: OTLP/JSON files to a store, batch by batch.

There is no watermark: rows of any age are accepted and references between signals are
not enforced. Ids are content hashes and the store keeps what it has, so a batch that is
run again after a failure adds nothing.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlake.sources import otlp
from emberlake.sources.store import ConflictError, Store
from emberlake.sources.telemetry import Telemetry

SCHEMAS = {"traces": otlp.TRACES, "logs": otlp.LOGS, "metrics": otlp.METRICS}


def load(store: Store, documents: DataFrame, signal: str, telemetry: Telemetry | None = None) -> None:
    """One batch of documents into the store. The batch is held while its tables are written."""
    documents = documents.persist()
    try:
        with (telemetry or Telemetry(False)).timed("emberlake.ingest.duration", signal):
            store.append(otlp.TABLES[signal](documents))
    finally:
        documents.unpersist()


def keep_within(store: Store, cap: int, every: float = 30.0, stop: threading.Event | None = None, telemetry: Telemetry | None = None) -> threading.Thread:
    """Hold the store under ``cap`` bytes: a pass at once, then one every so many seconds until ``stop`` is set.

    A pass that meets another writer's change is left to the next round; 0 means no cap.
    """
    stop = stop or threading.Event()

    def run() -> None:
        while cap and not stop.is_set():
            try:
                with (telemetry or Telemetry(False)).timed("emberlake.retention.duration"):
                    store.retain(cap)
            except ConflictError:
                pass
            stop.wait(every)

    thread = threading.Thread(target=run, name="retention", daemon=True)
    thread.start()
    return thread


def stream(spark: SparkSession, folder: str, signal: str, store: Store, checkpoint: str, files_per_batch: int = 100, once: bool = False) -> StreamingQuery:
    """Watch a folder for documents of one signal."""
    source = spark.readStream.schema(SCHEMAS[signal]).option("maxFilesPerTrigger", files_per_batch).json(folder)
    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: load(store, df, signal))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def windowed_counts(logs: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """An addition to the store's queries: records by service and tumbling window, with late records dropped after ``late``."""
    t = F.timestamp_micros(F.call_function("div", F.coalesce(F.nullif(F.col("timestamp"), F.lit(0)), F.col("observed_timestamp")), F.lit(1000).cast("long")))
    return logs.withColumn("at", t).withWatermark("at", late).groupBy(F.window("at", width), "service_name").agg(F.count(F.lit(1)).alias("records"))
