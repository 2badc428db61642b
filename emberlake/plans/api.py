"""The request surface: method names, named or positional parameters, JSON answers.

Everything below it is DataFrames; text is made here only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.operators import discovery, logs, metrics, retention, traces
from emberlake.plans import wire
from emberlake.plans.search import compiler, parser
from emberlake.sources.store import Store
from emberlake.sources.telemetry import Telemetry


class RpcError(Exception):
    code, said = -32603, "internal error"

    def __init__(self, detail: str = ""):
        super().__init__(detail or self.said)


def _error(name: str, number: int, said: str) -> type[RpcError]:
    return type(name, (RpcError,), {"code": number, "said": said})


ParseError = _error("ParseError", -32700, "parse error")
InvalidRequest = _error("InvalidRequest", -32600, "invalid request")
MethodNotFound = _error("MethodNotFound", -32601, "method not found")
InvalidParams = _error("InvalidParams", -32602, "invalid params")
TraceNotFound = _error("TraceNotFound", -32001, "trace not found")
LogNotFound = _error("LogNotFound", -32002, "log not found")
MetricNotFound = _error("MetricNotFound", -32003, "metric not found")
InvalidTraceID = _error("InvalidTraceID", -32004, "invalid trace id")
InvalidLogID = _error("InvalidLogID", -32005, "invalid log id")
InvalidQuery = _error("InvalidQuery", -32007, "invalid query")
InvalidSpanID = _error("InvalidSpanID", -32008, "invalid span id")
InvalidStreamID = _error("InvalidStreamID", -32009, "invalid stream id")
RequestCanceled = _error("RequestCanceled", -32010, "request canceled")

PARAMS: dict[str, tuple[str, ...]] = {
    "searchTraces": ("startTime", "endTime", "query"),
    "searchSpans": ("traceID", "query"),
    "getTraceSpanCount": ("traceID",),
    "searchLogs": ("startTime", "endTime", "query"),
    "getLog": ("logID",),
    "searchMetricSummaries": ("startTime", "endTime", "query"),
    "getMetric": ("streamID", "startTime", "endTime", "targetBuckets", "seriesIDs", "quantiles", "tzOffsetNs", "fitToData", "viewBuckets", "sparklineBuckets", "selectedSeriesIDs", "datapointSeriesIDs", "datapointSeriesLimit", "tzName"),
    "getTraceAttributes": ("startTime", "endTime"),
    "getLogAttributes": ("startTime", "endTime"),
    "getMetricAttributes": ("startTime", "endTime"),
    "getAttributesByTraceID": ("traceID",),
    "searchAttributes": ("term",),
    "getStats": (),
    "clearTraces": (),
    "clearLogs": (),
    "clearMetrics": (),
    "deleteSpansByTraceID": ("traceIDs",),
    "deleteSpanByID": ("spanIDs",),
    "deleteLogByID": ("logIDs",),
    "deleteMetricStream": ("streamID",),
}
PARAMS["getMetricAggregate"] = PARAMS["getMetric"]
VARIADIC = {"deleteSpansByTraceID", "deleteSpanByID", "deleteLogByID"}
MOST_BYTES = 1 << 20


def positional(method: str, params: Any) -> list:
    """Parameters in order; a named one that does not exist is an error, gaps are None."""
    names = PARAMS[method]
    if params is None:
        params = []
    if isinstance(params, dict):
        unknown = set(params) - set(names)
        if unknown:
            raise InvalidParams(f"unknown parameter {sorted(unknown)[0]!r}")
        return [params.get(n) for n in names]
    if not isinstance(params, list):
        raise InvalidParams("params must be a list or an object")
    if method in VARIADIC:
        flat = [x for p in params for x in (p if isinstance(p, list) else [p])]
        return [flat]
    if len(params) > len(names):
        raise InvalidParams(f"{method} takes at most {len(names)} parameters")
    return [*params, *[None] * (len(names) - len(params))]


def hex_id(value: Any, chars: int = 32, error: type[RpcError] = InvalidTraceID) -> str:
    text = str(value or "").replace("-", "").lower()
    if not re.fullmatch(rf"[0-9a-f]{{{chars}}}", text):
        raise error(f"not an id of {chars} hex digits: {value!r}")
    return text


def uuid_id(value: Any, error: type[RpcError]) -> str:
    """A content id as it is stored, dashed; taken with or without dashes."""
    h = hex_id(value, 32, error)
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def integer(value: Any, needed: bool = False) -> int | None:
    """Exact: a float is refused, a decimal string is taken."""
    if value is None and not needed:
        return None
    if isinstance(value, bool) or isinstance(value, float) or value is None:
        raise InvalidParams(f"not an integer: {value!r}")
    try:
        return int(value)
    except ValueError:
        raise InvalidParams(f"not an integer: {value!r}") from None


def count(value: Any) -> int:
    n = integer(value) or 0
    if n < 0:
        raise InvalidParams(f"a count below zero: {n}")
    return n


def fractions(value: Any) -> list[float]:
    out = [float(q) for q in value or []]
    if any(not 0 <= q <= 1 for q in out):
        raise InvalidParams("quantiles lie in 0 to 1")
    return out


def rows(df: DataFrame, *order) -> list[dict]:
    got = df.orderBy(*order) if order else df
    return [json.loads(r) for r in got.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toPandas()["j"]]


class Api:
    """Answers requests from a store."""

    def __init__(self, store: Store, telemetry: Telemetry | None = None):
        self.store = store
        self.telemetry = telemetry or Telemetry(False)

    def handle(self, body: str | bytes) -> str:
        """One JSON-RPC request to one response."""
        ident = None
        try:
            if len(body) > MOST_BYTES:
                raise InvalidRequest("the request is too large")
            try:
                request = json.loads(body)
            except ValueError as e:
                raise ParseError(str(e)) from None
            if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
                raise InvalidRequest
            ident = request.get("id")
            with self.telemetry.timed("emberlake.rpc.duration", request["method"]):
                answer = json.dumps({"jsonrpc": "2.0", "id": ident, "result": self.call(request["method"], request.get("params"))})
            self.telemetry.record("emberlake.rpc.response_bytes", len(answer.encode()), request["method"])
            return answer
        except RpcError as e:
            return json.dumps({"jsonrpc": "2.0", "id": ident, "error": {"code": e.code, "message": str(e)}})

    def call(self, method: str, params: Any = None) -> Any:
        if method not in PARAMS:
            raise MethodNotFound(f"unknown method {method!r}")
        run: Callable = getattr(self, f"_{method}")
        try:
            return run(*positional(method, params))
        except parser.SearchError as e:
            raise InvalidQuery(str(e)) from None
        except Py4JJavaError as e:
            if "cancel" in str(e.java_exception).lower():  # the job group of the request was cancelled
                raise RequestCanceled from None
            raise

    # parts

    def _tree(self, query: Any, fields: dict, signal: compiler.Signal):
        if not query:
            return None
        return parser.from_wire(query) if isinstance(query, dict) else parser.parse(query, self._known(str(query), signal) | fields)

    def _known(self, query: str, signal: compiler.Signal) -> dict:
        """Attributes that the query may name; where scopes share a key, the innermost counts."""
        words = sorted({w for part in (query.split(), re.split(r"[\s()\[\],=<>!\"'^$]+", query)) for w in part if w})
        rank = {s: i for i, s in enumerate(signal.scopes)}
        found = self.store.table("attributes").filter(F.col("key").isin(words) & F.col("scope").isin(list(rank))).select("key", "type", "scope").distinct().collect()
        inner = {"span": 9, "log": 9, "datapoint": 9}
        return {r.key: parser.Field(r.key, "attribute", r.type, r.scope) for r in sorted(found, key=lambda r: (inner.get(r.scope, -rank[r.scope]), r.type))}

    def _sources(self) -> compiler.Sources:
        return compiler.Sources(*(self.store.table(t) for t in ("attributes", "events", "links", "datapoints", "exemplars")))

    def _with_owners(self, df: DataFrame) -> DataFrame:
        res = self.store.table("resources").select(F.col("id").alias("resource_id"), F.col("attribute_ids").alias("resource_attribute_ids"), F.col("dropped_attributes_count").alias("resource_dropped_attributes_count"), F.col("seq").alias("resource_key"))
        named = [] if "scope_name" in df.columns else [F.col("name").alias("scope_name"), F.col("version").alias("scope_version")]  # a metric stream has its own
        sco = self.store.table("scopes").select(F.col("id").alias("scope_id"), F.col("attribute_ids").alias("scope_attribute_ids"), F.col("dropped_attributes_count").alias("scope_dropped_attributes_count"), *named, F.col("seq").alias("scope_key"))
        return df.join(res, "resource_id", "left").join(sco, "scope_id", "left")

    def _match(self, df: DataFrame, query: Any, fields: dict, signal: compiler.Signal) -> DataFrame:
        tree = self._tree(query, fields, signal)
        return df if tree is None else compiler.matching(self._with_owners(df), tree, signal, self._sources())

    # traces

    def _searchTraces(self, start, end, query):
        spans = self._match(self.store.table("spans"), query, compiler.SPAN_FIELDS, compiler.SPANS)
        return rows(traces.search_traces(spans, integer(start), integer(end)), F.desc("start_time"), "trace_id")

    def _searchSpans(self, trace_id, query):
        spans = self._with_owners(self.store.table("spans").filter(F.col("trace_id") == hex_id(trace_id)))
        tree = self._tree(query, compiler.SPAN_FIELDS, compiler.SPANS)
        spans = compiler.matching(spans, tree, compiler.SPANS, self._sources(), flag="hit") if tree is not None else spans.withColumn("hit", F.lit(True))
        t = self.store.table
        got = rows(wire.span_items(traces.search_spans(spans, F.col("hit")), t("events"), t("links"), t("attributes")), "position")
        if not got:
            raise TraceNotFound
        start, items = got[0]["traceStart"], []
        for x in got:
            del x["position"], x["traceStart"]
            salvaged = x.pop("salvaged")
            items.append(x | {"salvaged": True} if salvaged else {k: v for k, v in x.items() if k != "cyclePoint"})
        owners = {}
        for name, key, named in (("resources", "r", False), ("scopes", "s", True)):
            used = t(name).filter(F.col("seq").isin(sorted({x["spanData"][key] for x in got if x["spanData"][key] is not None})))
            owners[name] = {str(r["seq"]): r["obj"] for r in rows(wire.owner_objects(used, t("attributes"), named))}
        return {"traceID": hex_id(trace_id), "traceStart": start, **owners, "unplacedSpanCount": sum("salvaged" in x for x in items), "spans": items}

    def _getTraceSpanCount(self, trace_id):
        return traces.span_count(self.store.table("spans"), hex_id(trace_id)).first()[0]

    # logs

    def _searchLogs(self, start, end, query):
        found = self._match(self.store.table("logs"), query, compiler.LOG_FIELDS, compiler.LOGS)
        return rows(logs.search_logs(found, integer(start), integer(end)), F.desc("effective_time"), "id")

    def _getLog(self, log_id):
        t = self.store.table
        one = logs.get_log(t("logs"), uuid_id(log_id, InvalidLogID))
        res, sco = (wire.owner_objects(t(n).join(one.select(F.col(k).alias("id")), "id", "left_semi"), t("attributes"), n == "scopes") for n, k in (("resources", "resource_id"), ("scopes", "scope_id")))
        got = rows(wire.log_records(one, res, sco, t("attributes")))
        if not got:
            raise LogNotFound
        return got[0]

    # metrics

    def _points(self) -> DataFrame:
        p = self.store.table("datapoints").join(self.store.table("histogram_bounds").select(F.col("id").alias("bounds_id"), F.col("bounds").alias("explicit_bounds")), "bounds_id", "left")
        return p.withColumn("value", F.coalesce("double_value", F.col("int_value").cast("double")))

    def _searchMetricSummaries(self, start, end, query):
        streams, ingests = self.store.table("metric_streams"), self.store.table("metric_ingests")
        tree = self._tree(query, compiler.METRIC_FIELDS, compiler.METRICS)
        if tree is not None:  # decided for each arrival, then lifted to its stream
            each = ingests.join(streams.withColumnRenamed("id", "stream_id"), "stream_id")
            hit = compiler.matching(self._with_owners(each), tree, compiler.METRICS, self._sources())
            streams = streams.join(hit.select(F.col("stream_id").alias("id")).distinct(), "id", "left_semi")
        return rows(metrics.search_summaries(streams, self._points(), self.store.table("metric_series"), ingests, integer(start), integer(end)), F.desc_nulls_last("last_seen"), "stream_id")

    def _metric(self, p: list):
        r = metrics.Request(
            start=integer(p[1]), end=integer(p[2]), target_buckets=count(p[3]), series_ids=p[4], quantiles=fractions(p[5]), tz_offset_ns=integer(p[6]) or 0, fit_to_data=bool(p[7]), view_buckets=count(p[8]),
            sparkline_buckets=count(p[9]), selected_series_ids=p[10], datapoint_series_ids=p[11], datapoint_series_limit=integer(p[12]), tz_name=p[13],
        )
        got = self.store.table("metric_streams").filter(F.col("id") == uuid_id(p[0], InvalidStreamID)).first()
        if got is None:
            raise MetricNotFound
        points = self._points().filter(F.col("stream_id") == got.id)
        exemplars = self.store.table("exemplars").join(points.select(F.col("id").alias("datapoint_id")), "datapoint_id", "left_semi")
        return got, points, r, metrics.get_metric(points, got.metric_type, got.aggregation_temporality, r, exemplars)

    def _pools(self, answers: dict) -> dict:
        items = rows(wire.view_items(answers["pools"], answers["pool_slopes"], "pool"), "bucket_start") if "pools" in answers else []
        return {pool: [x["item"] for x in items if x["pool"] == pool] for pool in ("selected", "all")}

    def _aggregate(self, answers: dict) -> list | None:
        return [x["item"] for x in rows(wire.aggregate_items(answers["aggregate"]), "bucket_start")] if "aggregate" in answers else None

    def _getMetric(self, *p):
        stream, points, r, answers = self._metric(list(p))
        t = self.store.table
        dictionary = t("attributes")

        def by_series(name: str, items: list[dict]) -> dict[str, list]:
            out: dict[str, list] = {}
            for x in items:
                out.setdefault(x["series_id"], []).append(x[name])
            return out

        sent = by_series("item", rows(wire.datapoint_items(answers["datapoints"], stream.metric_type, stream.aggregation_temporality, stream.is_monotonic, answers.get("exemplars"), dictionary), F.desc("timestamp"), "id"))
        for items in sent.values():
            for x in items:
                if x["exemplarCount"] is None:
                    del x["exemplarCount"]
        series = t("metric_series").join(answers["window_counts"].select(F.col("series_id").alias("id")), "id", "left_semi")
        resources = {x["id"]: x["obj"] for x in rows(wire.owner_objects(t("resources").join(series.select(F.col("resource_id").alias("id")).distinct(), "id", "left_semi"), dictionary))}
        labels = {x["id"]: x for x in rows(wire.described(series, dictionary))}
        stats = {x["series_id"]: x for x in rows(answers["series"])} if "series" in answers else {}
        rates = {x["series_id"]: {"min": x["min_rate"], "max": x["max_rate"], "avg": x["avg_rate"]} for x in rows(answers["rate_stats"])} if "rate_stats" in answers else {}
        views = by_series("item", rows(wire.view_items(answers["views"], answers["slopes"], "series_id"), "bucket_start")) if "views" in answers else {}
        lines = by_series("p", rows(answers["sparkline"].select("series_id", "timestamp", "value", F.struct(F.col("timestamp").cast("string").alias("timestamp"), "value").alias("p")), "timestamp", "value")) if "sparkline" in answers else {}
        counts = rows(answers["window_counts"], "rank")
        timeseries = []
        for c in counts:
            i = c["series_id"]
            st = stats.get(i)
            timeseries.append({
                "attributesKey": i, "attributes": labels[i]["attributes"] if i in labels else [], "resource": resources.get(labels[i]["resource_id"]) if i in labels else None, "datapoints": sent.get(i, []),
                "stats": {"count": st["n"], "min": st["min_value"], "max": st["max_value"], "sum": st["sum_value"], "avg": st["avg_value"]} if st and st["n"] else None,
                "datapointCount": c["datapoint_count"], "lastSeenNs": str(c["latest"]), "rateStats": rates.get(i), "views": views.get(i), "sparkline": lines.get(i),
            })
        extent = metrics.window(points, r).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
        mismatch = answers["bounds_mismatch"].first() if "bounds_mismatch" in answers else None
        nothing = {"attributes": [], "droppedAttributesCount": 0}
        head = {"description": "", "metadata": [], "resource": nothing, "scope": {"name": stream.scope_name, "version": stream.scope_version, **nothing}}
        spoken = metrics.representative_ingest(t("metric_ingests"), points).first()
        if spoken is not None:
            one = t("metric_ingests").filter(F.col("id") == spoken.ingest_id)
            said = rows(wire.described(one, dictionary, "id", "metadata_ids"))[0]
            res, sco = (rows(wire.owner_objects(t(n).filter(F.col("id") == said[k]), dictionary)) for n, k in (("resources", "resource_id"), ("scopes", "scope_id")))
            head = {"description": said["description"], "metadata": said["attributes"], "resource": res[0]["obj"] if res else nothing, "scope": head["scope"] | (sco[0]["obj"] if sco else {})}
        return {
            "id": stream.id, "name": stream.name, "unit": stream.unit, "metricType": stream.metric_type, "aggregationTemporality": stream.aggregation_temporality, "isMonotonic": stream.is_monotonic, **head,
            "resourceDroppedAttributesCount": head["resource"]["droppedAttributesCount"], "scopeName": stream.scope_name, "scopeVersion": stream.scope_version, "scopeDroppedAttributesCount": head["scope"]["droppedAttributesCount"],
            "timeseries": timeseries, "aggregate": self._aggregate(answers), "scalarAggregate": self._pools(answers), "lastSeenNs": None if extent.b is None else str(extent.b), "datapointCount": sum(c["datapoint_count"] for c in counts),
            "boundsMismatch": {"seriesBuckets": mismatch.refused_rows, "aggregateBuckets": mismatch.refused_buckets} if mismatch and mismatch.refused_rows else None,
            "window": {"fittedToData": r.fit_to_data, "startNs": str(extent.a) if r.fit_to_data and extent.a is not None else None, "endNs": str(extent.b) if r.fit_to_data and extent.b is not None else None},
        }

    def _getMetricAggregate(self, *p):
        *_, answers = self._metric(list(p))
        return {"aggregate": self._aggregate(answers), "scalarAggregate": self._pools(answers)}

    # discovery

    def _getTraceAttributes(self, *_):
        return rows(discovery.attributes_of(self.store.table("attributes"), discovery.TRACE_SCOPES), "key", "scope", "type")

    def _getLogAttributes(self, *_):
        return rows(discovery.attributes_of(self.store.table("attributes"), discovery.LOG_SCOPES), "key", "scope", "type")

    def _getMetricAttributes(self, *_):
        return rows(discovery.attributes_of(self.store.table("attributes"), discovery.METRIC_SCOPES), "key", "scope", "type")

    def _getAttributesByTraceID(self, _):
        return self._getTraceAttributes()

    def _searchAttributes(self, term):
        return rows(discovery.search_attributes(self.store.table("attributes"), str(term or "")), "key", "scope", "type")

    def _getStats(self):
        t = self.store.tables()
        return {"signals": rows(discovery.stats(t["spans"], t["logs"], t["datapoints"])), "storageBytes": self.store.size_bytes()}

    # changes

    def _change(self, change: Callable[[dict], dict]) -> None:
        before = self.store.tables()
        after = change(before)
        self.store.replace({name: df for name, df in after.items() if df is not before[name]})

    def _clearTraces(self):
        self._change(lambda t: retention.sweep(retention.clear(t, "traces")))

    def _clearLogs(self):
        self._change(lambda t: retention.sweep(retention.clear(t, "logs")))

    def _clearMetrics(self):
        self._change(lambda t: retention.sweep(retention.clear(t, "metrics")))

    def _deleteSpansByTraceID(self, trace_ids):
        wanted = [hex_id(t) for t in trace_ids or []]
        self._change(lambda t: retention.delete_traces(t, wanted))
        return len(wanted)  # as asked for, not as found

    def _deleteSpanByID(self, span_ids):
        wanted = [hex_id(s, 16, InvalidSpanID) for s in span_ids or []]
        self._change(lambda t: retention.delete_spans(t, wanted))
        return len(wanted)

    def _deleteLogByID(self, log_ids):
        wanted = [uuid_id(i, InvalidLogID) for i in log_ids or []]
        self._change(lambda t: retention.delete_logs(t, wanted))
        return len(wanted)

    def _deleteMetricStream(self, stream_id):
        self._change(lambda t: retention.delete_stream(t, uuid_id(stream_id, InvalidStreamID)))
