"""Ingest, store, requests and streaming, end to end on small documents."""

import json

import pytest
from pyspark.sql import functions as F

from emberlake.operators import retention
from emberlake.plans.api import Api, InvalidLogID, InvalidParams, InvalidQuery, LogNotFound, MethodNotFound, TraceNotFound
from emberlake.plans.search import compiler
from emberlake.sources import store as st
from emberlake.sources.store import Store
from emberlake.sources.telemetry import Telemetry
from emberlake.streaming import ingest

T = 1_700_000_000_000_000_000
TRACE = "0af7651916cd43dd8448eb211c80319c"


def attr(key, **value):
    return {"key": key, "value": value}


RESOURCE = {"attributes": [attr("service.name", stringValue="shop"), attr("tags", arrayValue={"values": [{"stringValue": "a"}, {"stringValue": "b"}]})]}


def span(i, parent, **more):
    return {"traceId": TRACE, "spanId": f"{i:016x}", "parentSpanId": f"{parent:016x}" if parent else "", "name": f"op{i}", "kind": 2, "startTimeUnixNano": str(T + i), "endTimeUnixNano": str(T + 100 + i), "attributes": [attr("n", intValue=str(i))], **more}


def traces(*spans):
    return {"resourceSpans": [{"resource": RESOURCE, "scopeSpans": [{"scope": {"name": "lib", "version": "1"}, "spans": list(spans)}]}]}


SPANS = traces(span(1, 0), span(2, 1, status={"code": 2}, events=[{"name": "exception", "timeUnixNano": str(T + 5), "attributes": [attr("ek", stringValue="eventval")]}]), span(3, 9, links=[{"traceId": "ab" * 16, "spanId": "cd" * 8, "traceState": "st=1", "attributes": [attr("lk", stringValue="linkval")]}]), span(4, 5), span(5, 4))
LOGS = {
    "resourceLogs": [
        {
            "resource": RESOURCE,
            "scopeLogs": [{"logRecords": [{"timeUnixNano": str(T), "severityNumber": 9, "severityText": "INFO", "body": {"stringValue": "hello"}}, {"timeUnixNano": "0", "observedTimeUnixNano": str(T + 10**12), "severityNumber": 17, "severityText": "ERROR", "body": {"stringValue": "x" * 400}}]}],
        }
    ]
}


def _metric(name, kind, points, **more):
    return {"name": name, kind: {"dataPoints": points, **more}}


METRICS = {
    "resourceMetrics": [
        {
            "resource": RESOURCE,
            "scopeMetrics": [
                {
                    "metrics": [
                        _metric("g", "gauge", [{"timeUnixNano": str(T + i * 10**9), "asDouble": float(i), "attributes": [attr("color", stringValue="red")], "exemplars": [{"timeUnixNano": str(T), "asDouble": 1.0, "filteredAttributes": [attr("xk", stringValue="exval")]}]} for i in range(10)]),
                        _metric("s", "sum", [{"timeUnixNano": str(T + i * 10**9), "asInt": str(v)} for i, v in enumerate((1, 4, 9, 2, 5))], aggregationTemporality=2, isMonotonic=True),
                        _metric("h", "histogram", [{"timeUnixNano": str(T + i * 10**9), "count": "100", "sum": 25.5, "bucketCounts": ["10", "20", "30", "25", "15"], "explicitBounds": [0.5, 1, 1.5, 2]} for i in range(2)], aggregationTemporality=1),
                        _metric("e", "exponentialHistogram", [{"timeUnixNano": str(T), "count": "50", "scale": 2, "zeroCount": "5", "positive": {"offset": 1, "bucketCounts": ["5", "10", "15", "10", "5"]}, "negative": {"offset": 0, "bucketCounts": ["2", "3"]}}], aggregationTemporality=1),
                    ]
                }
            ],
        }
    ]
}


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("otlp")
    store = Store(spark, str(base / "store"))
    for signal, doc in (("traces", SPANS), ("logs", LOGS), ("metrics", METRICS)):
        (base / signal).mkdir()
        (base / signal / "1.json").write_text(json.dumps(doc))
        ingest.stream(spark, str(base / signal), signal, store, str(base / f"cp-{signal}"), once=True).awaitTermination()
    return Api(store)


def test_trace_list_and_tree(api):
    got = api.call("searchTraces", [])
    assert [(t["has_root_span"], t["service_name"], t["span_count"], t["error_count"]) for t in got] == [(True, "shop", 5, 1)]
    trace = api.call("searchSpans", {"traceID": TRACE, "query": "n = 2"})
    spans = trace["spans"]
    assert [(s["spanData"]["name"], s["depth"], s["matched"], s.get("salvaged", False), s.get("cyclePoint", False)) for s in spans] == [
        ("op1", 0, False, False, False), ("op2", 1, True, False, False), ("op3", 0, False, False, False), ("op4", 0, False, True, True), ("op5", 1, False, True, False),
    ]
    assert (trace["traceID"], trace["traceStart"], trace["unplacedSpanCount"]) == (TRACE, str(T + 1), 2)
    two, three = spans[1]["spanData"], spans[2]["spanData"]
    assert (two["start"], two["dur"], two["parentSpanID"], two["statusCode"]) == (1, 100, "0" * 15 + "1", "Error")
    assert two["attributes"] == [{"key": "n", "value": "2", "type": "int64"}] and two["links"] == []
    assert two["events"] == [{"name": "exception", "timestamp": str(T + 5), "droppedAttributesCount": 0, "attributes": [{"key": "ek", "value": "eventval", "type": "string"}]}]
    assert three["links"] == [{"traceID": "ab" * 16, "spanID": "cd" * 8, "traceState": "st=1", "droppedAttributesCount": 0, "flags": 0, "attributes": [{"key": "lk", "value": "linkval", "type": "string"}]}]
    assert [a["key"] for a in trace["resources"][str(two["r"])]["attributes"]] == ["service.name", "tags"]
    assert trace["scopes"][str(two["s"])] == {"name": "lib", "version": "1", "attributes": [], "droppedAttributesCount": 0}
    assert api.call("getTraceSpanCount", [TRACE]) == 5
    assert api.call("getTraceSpanCount", ["f" * 32]) == 0
    with pytest.raises(TraceNotFound):
        api.call("searchSpans", ["f" * 32])


def test_searches(api):
    assert api.call("searchTraces", {"query": "statusCode = Error AND event.name = exception"})[0]["span_count"] == 1
    assert api.call("searchTraces", {"query": "n > 3"})[0]["span_count"] == 2
    assert api.call("searchTraces", {"query": "tags CONTAINS a"})[0]["span_count"] == 5
    assert api.call("searchTraces", {"query": "exception"})[0]["span_count"] == 1
    assert api.call("searchTraces", [T + 10**12, None]) == []


def test_search_scopes(api):
    def spans(query):
        got = api.call("searchTraces", {"query": query})
        return got[0]["span_count"] if got else 0

    # attributes of events and links, by id, by value and for presence
    assert [spans(q) for q in ("ek = eventval", "ek CONTAINS entv", "ek != other", "ek != NULL", "ek = NULL", "ek = nothing")] == [1, 1, 1, 1, 0, 0]
    assert [spans(q) for q in ("lk = linkval", "lk ^ link", "link.traceState = 'st=1'", "link.droppedAttributesCount = 0")] == [1, 1, 1, 1]
    assert [spans(q) for q in ("n != NULL", "n = NULL", "service.name = NULL", "resource.droppedAttributesCount = 0", "droppedEventsCount = 0")] == [5, 0, 0, 5, 5]
    # free text: own, resource, event and link attributes, keys, links, array elements
    assert [spans(q) for q in ("shop", "eventval", "linkval", "lk", "'st=1'", "cdcd", "b", "lib")] == [5, 1, 1, 1, 1, 1, 5, 5]
    many = compiler.MOST_IDS
    try:
        compiler.MOST_IDS = 0  # the same through joins
        assert [spans(q) for q in ("ek CONTAINS entv", "n > 3", "linkval", "shop", "n = NULL")] == [1, 2, 1, 5, 0]
    finally:
        compiler.MOST_IDS = many
    with pytest.raises(InvalidQuery):
        api.call("searchTraces", {"query": "n > abc"})


def test_metric_searches(api):
    def names(query):
        return sorted(c["name"] for c in api.call("searchMetricSummaries", {"query": query}))

    assert [names(q) for q in ("name = g", "color = red", "color ^ re", "xk = exval", "xk CONTAINS xva", "color = NULL", "color = blue")] == [["g"], ["g"], ["g"], ["g"], ["g"], [], []]
    assert [names(q) for q in ("exval", "red", "color", "shop", "service.name = shop", "type = Sum", "name = g OR name = h")] == [["g"], ["g"], ["g"], ["e", "g", "h", "s"], ["e", "g", "h", "s"], ["s"], ["g", "h"]]


def test_logs(api):
    got = api.call("searchLogs", [])
    assert [(g["severity_text"], len(g["body_preview"])) for g in got] == [("ERROR", 300), ("INFO", 5)]
    one = api.call("getLog", [got[1]["id"]])
    assert (one["body"], one["timestamp"], one["severityNumber"], one["attributes"], one["scope"]["name"]) == ("hello", str(T), 9, [], "")
    assert one["resource"]["attributes"][0] == {"key": "service.name", "value": "shop", "type": "string"}
    with pytest.raises(LogNotFound):
        api.call("getLog", ["0" * 32])
    with pytest.raises(InvalidLogID):
        api.call("getLog", ["none"])


def test_metrics(api):
    cards = {c["name"]: c for c in api.call("searchMetricSummaries", [])}
    assert cards["g"]["last_value"] == 9 and cards["s"]["datapoint_count"] == 5 and cards["h"]["last_value"] is None
    s = api.call("getMetric", {"streamID": cards["s"]["stream_id"], "viewBuckets": 10, "sparklineBuckets": 5, "fitToData": True})
    (line,) = s["timeseries"]
    assert [p["delta"] for p in line["datapoints"]] == [3, 2, 5, 3, None]  # newest first
    assert any(v["hasReset"] for v in line["views"]) and s["isMonotonic"] and line["stats"] == {"count": 5, "min": 1, "max": 9, "sum": 21, "avg": 4.2}
    assert len(s["scalarAggregate"]["all"]) == len(line["views"]) and s["scalarAggregate"]["selected"] == [] and any(v["slope"] for v in s["scalarAggregate"]["all"])
    assert line["rateStats"]["max"] > 0 and line["sparkline"] and s["aggregate"] is None and s["window"] == {"fittedToData": True, "startNs": str(T), "endNs": str(T + 4 * 10**9)}
    g = api.call("getMetric", {"streamID": cards["g"]["stream_id"], "targetBuckets": 1, "fitToData": True})
    (line,) = g["timeseries"]
    values = {p["doubleValue"] for p in line["datapoints"]}
    assert {0, 9} <= values and len(values) <= 4  # first, last and at most two carriers of exemplars
    assert line["attributes"] == [{"key": "color", "value": "red", "type": "string"}] and line["datapointCount"] == 10 and line["lastSeenNs"] == str(T + 9 * 10**9)
    assert {e["filteredAttributes"][0]["value"] for p in line["datapoints"] for e in p["exemplars"]} == {"exval"} and all("exemplarCount" not in p for p in line["datapoints"])
    assert line["resource"]["attributes"][0]["value"] == g["resource"]["attributes"][0]["value"] == "shop"
    h = api.call("getMetric", {"streamID": cards["h"]["stream_id"], "targetBuckets": 1, "fitToData": True, "quantiles": [0.5]})
    assert h["aggregate"][0]["count"] == 200 and h["aggregate"][0]["bucketCounts"] == [20, 40, 60, 50, 30] and h["boundsMismatch"] is None
    assert h["timeseries"][0]["datapoints"][0]["explicitBounds"] == [0.5, 1, 1.5, 2] and h["timeseries"][0]["views"] is None
    e = api.call("getMetricAggregate", {"streamID": cards["e"]["stream_id"], "targetBuckets": 1, "fitToData": True, "quantiles": [0.9]})
    assert e["aggregate"][0]["zeroCount"] == 5 and e["aggregate"][0]["negativeBucketCounts"] == [2, 3] and set(e) == {"aggregate", "scalarAggregate"}
    empty = api.call("getMetric", {"streamID": cards["g"]["stream_id"], "startTime": 1, "endTime": 2})
    assert empty["timeseries"] == [] and empty["datapointCount"] == 0 and empty["lastSeenNs"] is None


def test_discovery_and_stats(api):
    assert {"key": "n", "scope": "span", "type": "int64"} in api.call("getTraceAttributes", [])
    assert api.call("searchAttributes", ["SHO"])[0]["samples"] == ["shop"]
    assert api.call("searchAttributes", ["  "]) == []
    stats = api.call("getStats")
    assert {s["signal"]: s["items"] for s in stats["signals"]} == {"traces": 5, "logs": 2, "metrics": 18} and stats["storageBytes"] > 0


def test_parameters(api):
    with pytest.raises(MethodNotFound):
        api.call("nothing")
    for bad in ({"nope": 1}, [1.5, None], "x"):
        with pytest.raises(InvalidParams):
            api.call("searchTraces", bad)
    answer = json.loads(api.handle('{"jsonrpc": "2.0", "id": 7, "method": "searchTraces", "params": {"query": "name ="}}'))
    assert answer["error"]["code"] == -32007 and answer["id"] == 7
    assert json.loads(api.handle("{"))["error"]["code"] == -32700
    codes = {("searchSpans", "x"): -32004, ("getLog", "x"): -32005, ("deleteSpanByID", "x"): -32008, ("getMetric", "x"): -32009, ("searchSpans", "f" * 32): -32001, ("getMetric", "f" * 32): -32003}
    for (method, given), code in codes.items():
        assert json.loads(api.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": [given]})))["error"]["code"] == code


def test_loading_again_adds_nothing(api, spark):
    before = {n: df.count() for n, df in api.store.tables().items()}
    docs = spark.read.schema(ingest.SCHEMAS["traces"]).json(spark.sparkContext.parallelize([json.dumps(SPANS)]))
    ingest.load(api.store, docs, "traces")
    assert {n: df.count() for n, df in api.store.tables().items()} == before
    seq = [r.seq for r in api.store.table("resources").collect()]
    assert len(seq) == len(set(seq))


def test_changes(api):
    assert api.call("deleteSpanByID", ["0000000000000002"]) == 1
    assert api.store.table("events").count() == 0 and api.store.table("spans").count() == 4
    api.call("clearTraces")
    left = api.store.tables()
    assert left["spans"].count() == 0 and left["logs"].count() == 2
    # nothing that is still used went, nothing unused stayed
    ids = {r.id for r in left["attributes"].select("id").collect()}
    used = {i for t in ("logs", "datapoints", "exemplars", "resources", "scopes") for r in left[t].select(F.explode("attribute_ids").alias("i")).collect() for i in [r.i]}
    assert ids == used
    api.store.retain(1)
    assert api.store.table("logs").count() < 2


def test_store_gate(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "other").write_text("1")
    with pytest.raises(st.VersionError):
        Store(spark, str(tmp_path / "x"))
    assert st.byte_size("512MB") == 512 * 10**6 and st.byte_size("") == st.DEFAULT_DISK and st.byte_size("0") == 0
    with pytest.raises(ValueError):
        st.byte_size("lots")


def test_order_statistics(spark):
    import random

    r = random.Random(3)
    for values in ([5], [1, 1, 1, 2], list(range(1000)), [r.randint(0, 50) for _ in range(3000)], [10**18 + r.randint(0, 10**15) for _ in range(3000)]):
        df = spark.createDataFrame([(v,) for v in values], "t long")
        s = sorted(values)
        for rank in {0, len(s) // 10, len(s) // 2, len(s) - 1}:
            assert retention.order_statistics(df, F.col("t"), rank, few=20) == (s[rank], s[min(rank + 1, len(s) - 1)])


@pytest.mark.parametrize("spread", [1, 6, 300, 2**62])
def test_order_statistics_of_times_closer_than_doubles_tell(spark, monkeypatch, spread):
    import random

    r, calls, sketch = random.Random(5), [], F.percentile_approx

    def counted(*a):
        calls.append(a)
        assert len(calls) < 200, "the range no longer narrows"
        return sketch(*a)

    monkeypatch.setattr(retention.F, "percentile_approx", counted)
    base = 1_700_000_000_000_000_000 if spread < 2**40 else -(2**61)
    s = sorted(base + r.randint(0, spread) for _ in range(1000))
    s = s if spread < 2**40 else [-(2**63), *s, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in s], "t long").coalesce(1)
    for rank in (0, len(s) // 10, len(s) // 2, len(s) - 1):
        assert retention.order_statistics(df, F.col("t"), rank, few=20) == (s[rank], s[min(rank + 1, len(s) - 1)])


def test_cutoff_computes_its_table_once(spark):
    sc = spark.sparkContext
    made, kept = sc.accumulator(0), len(sc._jsc.getPersistentRDDs())

    def row(i):
        made.add(1)
        return (i * 10,)

    df = spark.createDataFrame(sc.parallelize(range(3000), 2).map(row), "t long")
    assert retention.cutoff(df, F.col("t")) == 2999
    assert made.value == 3000 and len(sc._jsc.getPersistentRDDs()) == kept


@pytest.fixture
def small(spark, tmp_path):
    return Store(spark, str(tmp_path / "small"))


def log_rows(spark, *times):
    return spark.createDataFrame([(f"id{t}", t, "x") for t in times], "id string, timestamp long, body string")


def test_a_crash_leaves_the_last_snapshot(spark, small, monkeypatch):
    small.append({"logs": log_rows(spark, 1, 2)})
    before = small.snapshot()
    monkeypatch.setattr(small, "_write_text", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        small.replace({"logs": log_rows(spark, 9)})
    monkeypatch.undo()
    assert small.snapshot() == before and small.table("logs").count() == 2
    number, _ = small._latest()
    small.append({"logs": log_rows(spark, 2, 3)})  # 2 is known
    assert sorted(r.timestamp for r in small.table("logs").collect()) == [1, 2, 3]
    with pytest.raises(st.ConflictError):
        small._commit(number, {}, [])  # a writer that missed that change


def test_many_batches_are_put_together(spark, small, monkeypatch):
    monkeypatch.setattr(st, "MOST_FOLDERS", 3)
    for t in range(6):
        small.append({"logs": log_rows(spark, t, 100)})
    assert len(small.snapshot()["logs"]) <= 3 and small.table("logs").count() == 7
    old = small.table("logs")
    assert old.count() == 7  # folders that went are still there for readers
    monkeypatch.setattr(st, "GRACE_SECONDS", -1)
    small.replace({"logs": log_rows(spark, 5)})
    assert small.table("logs").count() == 1 and len(list(small._fs.listStatus(small._p("logs")))) == 1


def test_telemetry_can_be_ingested(spark, small):
    import threading

    t = Telemetry()
    with t.timed("emberlake.ingest.duration", "logs"):
        pass
    answer = Api(small, t).handle('{"jsonrpc": "2.0", "id": 1, "method": "getStats"}')
    stop = threading.Event()
    stop.set()
    ingest.keep_within(small, 1, 0.01, stop, t).join(10)
    t.record("emberlake.retention.duration", 3.0)
    docs = spark.read.schema(ingest.SCHEMAS["metrics"]).json(spark.sparkContext.parallelize([json.dumps(t.document())]))
    ingest.load(small, docs, "metrics")
    got = {r.name: r for r in small.table("metric_streams").collect()}
    assert set(got) == {"emberlake.ingest.duration", "emberlake.rpc.duration", "emberlake.rpc.response_bytes", "emberlake.retention.duration"} and got["emberlake.rpc.duration"].unit == "ms"
    sizes = small.table("datapoints").filter(F.col("stream_id") == got["emberlake.rpc.response_bytes"].id).collect()
    assert [(r["count"], r["sum"]) for r in sizes] == [(1, len(answer))]
    assert Telemetry(False).document()["resourceMetrics"][0]["scopeMetrics"][0]["metrics"] == []


def test_badges():
    from emberlake.operators import metrics

    assert metrics.stat_badges("Sum", "Delta", "raw") == ("min", "max", "avg", "total")
    assert metrics.stat_badges("Sum", "Cumulative", "rate") == ("min", "max") and metrics.stat_badges("Gauge", "", "raw") == ("min", "max", "avg")
    assert metrics.slope_offered("Sum", "Cumulative", True, "rate") and not metrics.slope_offered("Sum", "Delta", True, "rate")
