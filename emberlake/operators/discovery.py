"""Attribute discovery and store statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACE_SCOPES = ("resource", "scope", "span", "event", "link")
LOG_SCOPES = ("resource", "scope", "log")
METRIC_SCOPES = ("resource", "scope", "datapoint", "exemplar")
SAMPLES = 3


def attributes_of(dictionary: DataFrame, scopes: tuple[str, ...]) -> DataFrame:
    """Distinct (key, scope, type) that a signal may carry. The dictionary is store-wide: no window applies."""
    return dictionary.filter(F.col("scope").isin(*scopes)).select("key", "scope", "type").distinct()


def _like(column: Column, term: str) -> Column:

    return F.contains(F.lower(column), F.lower(F.lit(term)))


def search_attributes(dictionary: DataFrame, term: str) -> DataFrame:
    """Value-first search: keys with a value (or a name) that contains the term, any case, with up to three sample values."""
    if not term.strip():
        return dictionary.select("key", "scope", "type", F.lit(0).cast("long").alias("value_count"), F.array("value").alias("samples")).limit(0)
    hit = dictionary.filter(_like(F.col("value"), term) | _like(F.col("key"), term))
    return hit.groupBy("key", "scope", "type").agg(F.count(F.lit(1)).alias("value_count"), F.slice(F.array_sort(F.collect_set("value")), 1, SAMPLES).alias("samples"))


def resolve(owners: DataFrame, dictionary: DataFrame, key: str, scope: str) -> DataFrame:
    """Owners with the value they carry under a key (null without it): one small dictionary slice joined to exploded ids."""
    slice_ = dictionary.filter((F.col("key") == key) & (F.col("scope") == scope)).select(F.col("id").alias("attribute_id"), "value")
    pairs = owners.select("span_id", F.explode("attribute_ids").alias("attribute_id")).join(slice_, "attribute_id")
    return owners.join(pairs.groupBy("span_id").agg(F.min("value").alias("value")), "span_id", "left")


def attribute_lists(owners: DataFrame, dictionary: DataFrame, owner: str = "span_id") -> DataFrame:
    """Each owner's attributes in order of key, then id."""
    pairs = owners.select(owner, F.explode("attribute_ids").alias("id")).join(dictionary, "id")
    entry = F.struct("key", "id", "value", "type")
    return pairs.groupBy(owner).agg(F.array_sort(F.collect_list(entry)).alias("attributes"))


def stats(spans: DataFrame, logs: DataFrame, points: DataFrame) -> DataFrame:
    """Counts, errors and last arrival of each signal, a row each."""
    t = spans.agg(
        F.lit("traces").alias("signal"), F.count(F.lit(1)).alias("items"), F.count_distinct("trace_id").alias("groups"), F.count_distinct(F.nullif("service_name", F.lit(""))).alias("services"),
        F.count_if(F.col("status_code") == "Error").alias("errors"), F.max("end_time").alias("last_received"),
    )
    latest = F.coalesce(F.nullif(F.max("timestamp"), F.lit(0)), F.max("observed_timestamp"))
    lg = logs.agg(
        F.lit("logs").alias("signal"), F.count(F.lit(1)).alias("items"), F.count_distinct("trace_id").alias("groups"), F.count_distinct(F.nullif("service_name", F.lit(""))).alias("services"),
        F.count_if(F.col("severity_number") >= 17).alias("errors"), latest.alias("last_received"),
    )
    m = points.agg(
        F.lit("metrics").alias("signal"), F.count(F.lit(1)).alias("items"), F.count_distinct("stream_id").alias("groups"), F.count_distinct("series_id").alias("services"), F.lit(0).cast("long").alias("errors"),
        F.max("timestamp").alias("last_received"),
    )
    return t.unionByName(lg).unionByName(m)
