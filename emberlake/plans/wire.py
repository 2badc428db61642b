"""Answers in their wire shapes: nested structs built as columns, one row for each item of an answer.

The names of the fields are fixed values of the request surface. Absolute times are
decimal strings, as they exceed what a JSON number holds exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST = "array<struct<key:string,value:string,type:string>>"


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def attributes(owners: DataFrame, dictionary: DataFrame, owner: str = "id", array: str = "attribute_ids") -> DataFrame:
    """(owner, attributes): what each owner carries, by key, then id. Ids are joined to the dictionary once for all owners."""
    pairs = owners.select(owner, F.explode(array).alias("_attribute")).distinct()
    found = pairs.join(dictionary.select(F.col("id").alias("_attribute"), "key", "value", "type"), "_attribute")
    got = found.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("key", "_attribute", "value", "type"))).alias("a"))
    return got.select(owner, F.transform("a", lambda x: F.struct(x.key.alias("key"), x.value.alias("value"), x.type.alias("type"))).alias("attributes"))


def described(df: DataFrame, dictionary: DataFrame, owner: str = "id", array: str = "attribute_ids") -> DataFrame:
    """``df`` with a column ``attributes``, empty where there are none."""
    out = df.join(attributes(df, dictionary, owner, array), owner, "left")
    return out.withColumn("attributes", F.coalesce("attributes", F.array().cast(LIST)))


def owner_objects(table: DataFrame, dictionary: DataFrame, named: bool = False) -> DataFrame:
    """(id, seq, obj) of resources, or of scopes if ``named``."""
    name = [F.coalesce("name", F.lit("")).alias("name"), F.coalesce("version", F.lit("")).alias("version")] if named else []
    obj = F.struct(*name, "attributes", F.col("dropped_attributes_count").alias("droppedAttributesCount"))
    return described(table, dictionary).select("id", "seq", obj.alias("obj"))


def event_lists(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    item = F.struct("name", text("timestamp").alias("timestamp"), F.col("dropped_attributes_count").alias("droppedAttributesCount"), "attributes")
    e = described(events, dictionary).groupBy("span_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "id", item.alias("item")))).alias("events"))
    return e.select("span_id", F.transform("events", lambda x: x.item).alias("events"))


def link_lists(links: DataFrame, dictionary: DataFrame) -> DataFrame:
    item = F.struct(
        F.col("trace_id").alias("traceID"), F.col("linked_span_id").alias("spanID"), F.col("trace_state").alias("traceState"), F.col("dropped_attributes_count").alias("droppedAttributesCount"), "flags", "attributes"
    )
    e = described(links, dictionary).groupBy("span_id").agg(F.array_sort(F.collect_list(F.struct("id", item.alias("item")))).alias("links"))
    return e.select("span_id", F.transform("links", lambda x: x.item).alias("links"))


def span_items(placed: DataFrame, events: DataFrame, links: DataFrame, dictionary: DataFrame) -> DataFrame:
    """What `search_spans` places, one item for each span, with its place in the trace. Owners are named by their short keys."""
    own = placed.select("span_id").distinct()
    s = described(placed, dictionary, "span_id")
    for name, lists in (("events", event_lists(events.join(own, "span_id", "left_semi"), dictionary)), ("links", link_lists(links.join(own, "span_id", "left_semi"), dictionary))):
        s = s.join(lists, "span_id", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    data = F.struct(
        F.col("trace_state").alias("traceState"), F.col("span_id").alias("spanID"), F.col("parent_span_id").alias("parentSpanID"), "flags", "name", "kind", F.col("offset_ns").alias("start"), F.col("duration_ns").alias("dur"),
        "attributes", "events", "links", F.col("resource_key").alias("r"), F.col("scope_key").alias("s"), F.col("dropped_attributes_count").alias("droppedAttributesCount"),
        F.col("dropped_events_count").alias("droppedEventsCount"), F.col("dropped_links_count").alias("droppedLinksCount"), F.col("status_code").alias("statusCode"), F.col("status_message").alias("statusMessage"),
    )
    return s.select(data.alias("spanData"), "depth", "matched", "salvaged", F.col("cycle_point").alias("cyclePoint"), "position", text("trace_start").alias("traceStart"))


def log_records(logs: DataFrame, resources: DataFrame, scopes: DataFrame, dictionary: DataFrame) -> DataFrame:
    res, sco = (t.select(F.col("id").alias(f"{n}_id"), F.col("obj").alias(n)) for t, n in ((resources, "resource"), (scopes, "scope")))
    rec = described(logs, dictionary).join(res, "resource_id", "left").join(sco, "scope_id", "left")
    return rec.select(
        "id", text("timestamp").alias("timestamp"), text("observed_timestamp").alias("observedTimestamp"), F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"), F.col("severity_text").alias("severityText"),
        F.col("severity_number").alias("severityNumber"), "body", F.col("body_type").alias("bodyType"), "resource", "scope", F.col("dropped_attributes_count").alias("droppedAttributesCount"), "flags",
        F.col("event_name").alias("eventName"), "attributes",
    )


SCALAR = {"doubleValue": "double_value", "intValue": "int_value", "valueType": "value_type"}
TOTALS = {"count": "count", "sum": "sum", "min": "min", "max": "max"}
EXPLICIT = {"bucketCounts": "bucket_counts", "explicitBounds": "explicit_bounds"}
EXPONENTIAL = {
    "scale": "scale", "zeroCount": "zero_count", "zeroThreshold": "zero_threshold", "positiveBucketOffset": "positive_bucket_offset", "positiveBucketCounts": "positive_bucket_counts",
    "negativeBucketOffset": "negative_bucket_offset", "negativeBucketCounts": "negative_bucket_counts",
}


def _fields(df: DataFrame, names: dict[str, str]) -> list[Column]:
    return [(F.col(c) if c in df.columns else F.lit(None)).alias(n) for n, c in names.items()]


def datapoint_items(points: DataFrame, metric_type: str, temporality: str, monotonic: bool, exemplars: DataFrame | None, dictionary: DataFrame) -> DataFrame:
    """(series_id, timestamp, id, item) of the points that are sent; exemplarCount only where some are withheld."""
    p = points
    if exemplars is not None:
        item = F.struct(text("timestamp").alias("timestamp"), "value", F.col("trace_id").alias("traceID"), F.col("span_id").alias("spanID"), F.col("attributes").alias("filteredAttributes"))
        e = described(exemplars, dictionary).groupBy(F.col("datapoint_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x.item).alias("exemplars"), F.max("exemplar_count").alias("all"))
        p = p.join(e, "id", "left").withColumn("exemplars", F.coalesce("exemplars", F.array().cast(e.schema["exemplars"].dataType)))
        held = F.when(F.col("all") > F.size("exemplars"), F.col("all"))
    else:
        p, held = p.withColumn("exemplars", F.array().cast("array<string>")), F.lit(None).cast("long")
    head = [F.col("id"), F.lit(metric_type).alias("metricType"), text("timestamp").alias("timestamp"), F.floor(F.col("timestamp") / 1_000_000).alias("timestampMs"), text("start_time").alias("startTime"), *_fields(p, {"flags": "flags"}), F.col("exemplars")]
    if metric_type == "Gauge":
        body = _fields(p, SCALAR)
    elif metric_type == "Sum":
        body = [*_fields(p, SCALAR), F.lit(monotonic).alias("isMonotonic"), F.lit(temporality).alias("aggregationTemporality"), *_fields(p, {"delta": "delta", "isReset": "is_reset"})]
    else:
        body = [*_fields(p, TOTALS), *_fields(p, EXPLICIT if metric_type == "Histogram" else EXPONENTIAL), *_fields(p, {"quantiles": "quantiles"}), F.lit(temporality).alias("aggregationTemporality")]
    return p.select("series_id", "timestamp", "id", F.struct(*head, *body, held.alias("exemplarCount")).alias("item"))


def view_items(view: DataFrame, slopes: DataFrame, by: str) -> DataFrame:
    """(by, bucket_start, item) of per-bucket lines with their slopes."""
    v = view.join(slopes.select(by, "bucket_start", "slope"), [by, "bucket_start"], "left")
    item = F.struct(text("bucket_start").alias("bucketStart"), F.col("sample_count").alias("sampleCount"), F.col("value_sum").alias("sum"), F.col("value_avg").alias("avg"), "rate", "slope", F.col("has_reset").alias("hasReset"))
    return v.select(by, "bucket_start", item.alias("item"))


def aggregate_items(merged: DataFrame) -> DataFrame:
    """(bucket_start, item) of the histogram over all series."""
    body = EXPLICIT if "explicit_bounds" in merged.columns else EXPONENTIAL
    item = F.struct(text("timestamp").alias("timestamp"), text("start_time").alias("startTime"), *_fields(merged, TOTALS), *_fields(merged, body), *_fields(merged, {"quantiles": "quantiles"}))
    return merged.select("bucket_start", item.alias("item"))
