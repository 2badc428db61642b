"""Synthetic telemetry for trials: traces, logs and metrics of any size, made by Spark itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERVICES = ("checkout", "cart", "payment", "inventory", "search", "gateway")


def _pick(names: tuple[str, ...], seed: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(seed, F.lit(len(names))) + 1).cast("int"))


def spans(spark: SparkSession, traces: int, per_trace: int = 15, start: int = 1_700_000_000_000_000_000, orphans: int = 0, cycles: int = 0) -> DataFrame:
    """Heap-shaped traces. Every ``orphans``-th trace names a missing parent, every ``cycles``-th has a ring of two (0: none)."""
    s = spark.range(traces).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(1), F.lit(per_trace))).alias("n"))
    name = lambda n: F.lpad(F.hex(F.col("t") * 65536 + n), 16, "0")
    up = F.when(F.col("n") > 1, name(F.floor(F.col("n") / 2)))
    if cycles:
        up = F.when((F.col("t") % cycles == 0) & F.col("n").isin(2, 3), name(F.lit(5) - F.col("n"))).otherwise(up)
    if orphans:
        up = F.when((F.col("t") % orphans == 0) & (F.col("n") == 2), name(F.lit(65535))).otherwise(up)
    begin = F.lit(start) + F.col("t") * 1_000_000 + F.col("n") * 1000
    h = F.xxhash64("t", "n")
    return s.select(
        F.lower(F.lpad(F.hex("t"), 32, "0")).alias("trace_id"), F.lower(name(F.col("n"))).alias("span_id"), F.lower(up).alias("parent_span_id"), F.concat(F.lit("op-"), F.pmod(h, F.lit(20)).cast("string")).alias("name"),
        F.when(F.col("n") == 1, "Server").otherwise("Internal").alias("kind"), begin.alias("start_time"), (begin + F.pmod(h, F.lit(5_000_000))).alias("end_time"), F.when(F.pmod(h, F.lit(50)) == 0, "Error").otherwise("Ok").alias("status_code"),
        _pick(SERVICES, h).alias("service_name"),
    )


def gauge(spark: SparkSession, series: int, points: int, step: int = 10**9, start: int = 1_700_000_000_000_000_000) -> DataFrame:
    """Waves with noise, one stream."""
    s = spark.range(series).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    value = F.sin(F.col("i") / 50.0 + F.col("s")) * 100 + F.pmod(F.xxhash64("s", "i"), F.lit(1000)) / 100.0
    return s.select(F.concat_ws("-", "s", "i").alias("id"), F.lit("wave").alias("stream_id"), F.concat(F.lit("s"), "s").alias("series_id"), (F.lit(start) + F.col("i").cast("long") * step).alias("timestamp"), value.alias("value"))


def logs(spark: SparkSession, records: int, start: int = 1_700_000_000_000_000_000) -> DataFrame:
    """Records of which every tenth lacks a time of its own."""
    h = F.xxhash64("id")
    at = F.lit(start) + F.col("id") * 1_000_000
    level = F.when(F.pmod(h, F.lit(20)) == 0, 17).when(F.pmod(h, F.lit(7)) == 0, 13).otherwise(9)
    return spark.range(records).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 10 == 0, 0).otherwise(at).alias("timestamp"), (at + 50).alias("observed_timestamp"), level.alias("severity_number"),
        F.concat(F.lit("request took "), F.pmod(h, F.lit(900)).cast("string"), F.lit(" ms")).alias("body"), F.lit("string").alias("body_type"), _pick(SERVICES, h).alias("service_name"), F.lit("").alias("event_name"),
        F.lpad(F.hex(F.col("id") % 1000), 32, "0").alias("trace_id"), F.lit("").alias("severity_text"),
    )
