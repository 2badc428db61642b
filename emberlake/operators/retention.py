"""Deletes, orphan sweeps and retention, as plans that give the rows to keep."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE, ROUNDS = 0.10, 3
Tables = dict[str, DataFrame]

# Child tables of each parent: (child, its column, the parent's column).
CHILDREN: dict[str, tuple[tuple[str, str, str], ...]] = {
    "spans": (("events", "span_id", "span_id"), ("links", "span_id", "span_id")),
    "datapoints": (("exemplars", "datapoint_id", "id"),),
    "metric_streams": (("datapoints", "stream_id", "id"), ("metric_series", "stream_id", "id"), ("metric_ingests", "stream_id", "id")),
}
SIGNALS = {"traces": ("events", "links", "spans"), "logs": ("logs",), "metrics": ("exemplars", "datapoints", "metric_ingests", "metric_series", "metric_streams")}
ID_ARRAYS = {"resources": "attribute_ids", "scopes": "attribute_ids", "spans": "attribute_ids", "events": "attribute_ids", "links": "attribute_ids", "logs": "attribute_ids", "metric_series": "attribute_ids", "datapoints": "attribute_ids", "exemplars": "attribute_ids", "metric_ingests": "metadata_ids"}


def without(table: DataFrame, gone: DataFrame, column: str, other: str) -> DataFrame:
    keys = gone.select(F.col(other).alias(column)).distinct()
    return table.join(keys, column, "left_anti").select(table.columns)


def delete(tables: Tables, name: str, gone: DataFrame) -> Tables:
    """Tables after the rows ``gone`` of table ``name`` and all their children went; unknown ids are no error."""
    key = "span_id" if name == "spans" else "id"
    return _without_children(tables, name, gone) | {name: without(tables[name], gone, key, key)}


def _without_children(tables: Tables, name: str, gone: DataFrame) -> Tables:
    out = dict(tables)
    for child, column, own in CHILDREN.get(name, ()):
        if child in out:
            if child in CHILDREN:
                out = _without_children(out, child, out[child].join(gone.select(F.col(own).alias(column)).distinct(), column, "left_semi"))
            out[child] = without(out[child], gone, column, own)
    return out


def delete_traces(tables: Tables, trace_ids: list[str]) -> Tables:
    return delete(tables, "spans", tables["spans"].filter(F.col("trace_id").isin(trace_ids)))


def delete_spans(tables: Tables, span_ids: list[str]) -> Tables:
    return delete(tables, "spans", tables["spans"].filter(F.col("span_id").isin(span_ids)))


def delete_logs(tables: Tables, log_ids: list[str]) -> Tables:
    return delete(tables, "logs", tables["logs"].filter(F.col("id").isin(log_ids)))


def delete_stream(tables: Tables, stream_id: str) -> Tables:
    return delete(tables, "metric_streams", tables["metric_streams"].filter(F.col("id") == stream_id))


def clear(tables: Tables, signal: str) -> Tables:
    return tables | {t: tables[t].limit(0) for t in SIGNALS[signal] if t in tables}


def _used(tables: Tables, column: str) -> DataFrame | None:
    parts = [t.select(F.col(column).alias("id")) for t in tables.values() if column in t.columns]
    out = None
    for p in parts:
        out = p if out is None else out.union(p)
    return out


def live_attributes(tables: Tables) -> DataFrame:
    """Ids that any owner array still holds, metadata of ingests included."""
    out = None
    for name, column in ID_ARRAYS.items():
        if name in tables:
            ids = tables[name].select(F.explode(column).alias("id"))
            out = ids if out is None else out.union(ids)
    return out.distinct()


def sweep(tables: Tables) -> Tables:
    """Drop resources, scopes, then attributes and bounds that nothing refers to."""
    out = dict(tables)
    for name, column in (("resources", "resource_id"), ("scopes", "scope_id")):
        used = _used(out, column)
        if name in out and used is not None:
            out[name] = out[name].join(used.distinct(), "id", "left_semi")
    if "attributes" in out:
        out["attributes"] = out["attributes"].join(live_attributes(out), "id", "left_semi")
    if "histogram_bounds" in out:
        out["histogram_bounds"] = out["histogram_bounds"].join(out["datapoints"].select(F.col("bounds_id").alias("id")).distinct(), "id", "left_semi")
    return out


def sweep_metric_identity(tables: Tables) -> Tables:
    """After points were pruned: series, ingests and streams without any go."""
    out = dict(tables)
    d = out["datapoints"]
    for name, column in (("metric_series", "series_id"), ("metric_ingests", "metric_ingest_id"), ("metric_streams", "stream_id")):
        if name in out:
            out[name] = out[name].join(d.select(F.col(column).alias("id")).distinct(), "id", "left_semi")
    return out


def order_statistics(table: DataFrame, value, rank: int, few: int = 10_000) -> tuple[int, int]:
    """The values (whole numbers) at ``rank`` and the next one (or the last), counted from 0, by narrowing a range.

    Each pass sketches percentiles of what is left and counts the rows on either side, so no
    task ever holds more than the sketch; at most ``few`` rows are sorted in the end. The sketch
    works on doubles, so it gets distances from the least value left: times as they are would be
    rounded by 128 ns and more, out of a narrow range, which then never narrows.
    """
    v = table.select(value.cast("long").alias("v")).filter("v is not null")
    low, high, size = v.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    below, last = 0, rank + 1 if rank + 1 < size else rank
    while size > few and low < high:
        left = v.filter(F.col("v").between(low, high))
        share = [max(0.0, (rank - below) / size - 0.001), min(1.0, (last + 1 - below) / size + 0.001)]
        a, b = low, high
        if high - low < 2**63:
            near, far = left.agg(F.percentile_approx(F.col("v") - F.lit(low).cast("long"), share, 10_000)).first()[0]
            a, b = min(low + near, high), min(low + far, high)
        if (a, b) == (low, high):
            b = low + (high - low) // 2  # the sketch does not narrow: halve the range
        before, inside = left.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v").between(a, b))).first()
        upto = below + before + inside
        if last < below + before:
            high, size = a - 1, before
        elif rank < below + before:  # the two values lie on either side of a
            return left.filter(F.col("v") < a).agg(F.max("v")).first()[0], left.filter(F.col("v") >= a).agg(F.min("v")).first()[0]
        elif last < upto:
            low, high, below, size = a, b, below + before, inside
        elif rank < upto:  # on either side of b
            return left.filter(F.col("v") <= b).agg(F.max("v")).first()[0], left.filter(F.col("v") > b).agg(F.min("v")).first()[0]
        else:
            low, below, size = b + 1, upto, size - before - inside
    if low == high:
        return low, high
    got = sorted(r[0] for r in v.filter(F.col("v").between(low, high)).collect())
    return got[rank - below], got[last - below]


def cutoff(table: DataFrame, time, share: float = SHARE) -> int | None:
    """Time below which the oldest ``share`` of rows lies, interpolated between the two rows around it.

    The times alone are kept on disk meanwhile: each pass over a table that comes of joins or
    windows would shuffle all of it anew.
    """
    times = table.select(time.cast("long").alias("v")).filter("v is not null").persist(StorageLevel.DISK_ONLY)
    try:
        n = times.count()
        if not n:
            return None
        at = share * (n - 1)
        low, high = order_statistics(times, F.col("v"), int(at))
        return round(float(low) + (float(high) - float(low)) * (at - int(at)))
    finally:
        times.unpersist()


def prune_round(tables: Tables, share: float = SHARE) -> Tables:
    """One round of retention: of each signal, rows strictly older than its cut-off go, with their children."""
    from emberlake.operators.logs import effective_time

    out = dict(tables)
    for name, time in (("spans", F.col("start_time")), ("logs", effective_time()), ("datapoints", F.col("timestamp"))):
        if name in out and (t := cutoff(out[name], time, share)) is not None:
            out = delete(out, name, out[name].filter(time < t))
    return sweep_metric_identity(out) if "datapoints" in out and "metric_series" in out else out


def retain(tables: Tables, measure, cap: int, rounds: int = ROUNDS) -> Tables:
    """Sweep, then prune in at most ``rounds`` rounds while ``measure(tables)`` bytes exceed the cap."""
    if not cap or measure(tables) <= cap:
        return tables
    out = sweep(tables)
    for _ in range(rounds):
        if measure(out) <= cap:
            break
        out = sweep(prune_round(out))
    return out
