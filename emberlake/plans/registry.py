"""Registered queries over the derived telemetry tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.functions import buckets, hist, ids
from emberlake.operators import discovery, logs, metrics, retention, traces
from emberlake.plans import fixtures as fx
from emberlake.plans.fixtures import derived, oracle
from emberlake.plans.search import compiler, parser
from emberlake.sources import otlp

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY = 86_400_000_000_000
JAN10, JAN20 = 1_704_844_800_000_000_000, 1_705_708_800_000_000_000  # 2024-01-10 and -20, UTC
Y97, Y98 = 852_076_800_000_000_000, 883_612_800_000_000_000
FULL = (1_704_067_200_000_000_000, 1_706_659_200_000_000_000)  # 2024-01-01 to -31


def register(name: str, sql: str | None = None, *needs: str):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql, *needs)
        return f

    return add


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


# ---- traces ------------------------------------------------------------------------

_TRACE_SQL = """select trace_id, count(*) filter (where parent_span_id is null) > 0 as has_root_span,
  nullif(min_by(service_name, span_id) filter (where parent_span_id is null), '') as service_name, min_by(name, span_id) filter (where parent_span_id is null) as root_name,
  min(start_time) as start_time, max(end_time) - min(start_time) as duration_ns, count(*) as span_count, count(*) filter (where status_code = 'Error') as error_count from d_spans {where} group by trace_id"""


@register("search_traces", _TRACE_SQL.format(where=""), "d_spans")
def search_traces(spark, d):
    return traces.search_traces(derived(spark, d, "d_spans"))


@register("search_traces_window", _TRACE_SQL.format(where=f"where start_time between {Y97} and {Y98}"), "d_spans")
def search_traces_window(spark, d):
    return traces.search_traces(derived(spark, d, "d_spans"), Y97, Y98)


@register("search_traces_query", _TRACE_SQL.format(where="where status_code = 'Error' and (name = 'ECONOMY' or quantity >= 40)"), "d_spans")
def search_traces_query(spark, d):
    fields = compiler.SPAN_FIELDS | {"line.quantity": parser.Field("line.quantity", "attribute", "int64", "span")}
    tree = parser.parse('statusCode = Error AND (name = "ECONOMY" OR line.quantity >= 40)', fields)
    spans = derived(spark, d, "d_spans")
    own = fx.spans_with_attributes(spans)
    return traces.search_traces(compiler.matching(own, tree, compiler.SPANS, compiler.Sources(fx.attributes_of(spans))))


@register("trace_list_top", f"select trace_id, start_time, span_count from ({_TRACE_SQL.format(where='')}) x order by start_time desc, trace_id limit 50", "d_spans")
def trace_list_top(spark, d):
    return traces.search_traces(derived(spark, d, "d_spans"), limit=50).select("trace_id", "start_time", "span_count")


@register("trace_span_count", "select count(*) as span_count from d_spans where trace_id = lpad('1', 32, '0')", "d_spans")
def trace_span_count(spark, d):
    return traces.span_count(derived(spark, d, "d_spans"), "1".zfill(32))


@register("trace_span_count_unknown", "select 0::bigint as span_count")
def trace_span_count_unknown(spark, d):
    return traces.span_count(derived(spark, d, "d_spans"), "f" * 32)


_TREE_SQL = """with recursive have as (select trace_id, span_id from {t}),
up as (select s.trace_id, s.span_id, s.start_time, s.parent_span_id, h.span_id as up from {t} s left join have h on h.trace_id = s.trace_id and h.span_id = s.parent_span_id),
ranks as (select *, row_number() over (partition by trace_id, up order by case when up is null then parent_span_id is not null end, start_time, span_id) as r from up),
walk as (select trace_id, span_id, 0 as depth, [r] as path from ranks where up is null
  union all select c.trace_id, c.span_id, w.depth + 1, list_append(w.path, c.r) from walk w join ranks c on c.trace_id = w.trace_id and c.up = w.span_id)
select trace_id, span_id, cast(depth as integer) as depth, array_to_string(path, '.') as path from walk"""


@register("span_tree", _TREE_SQL.format(t="d_spans"), "d_spans")
def span_tree(spark, d):
    return traces.span_tree(derived(spark, d, "d_spans")).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "."))


@register("span_tree_cycles", _TREE_SQL.format(t="d_span_cycles"), "d_span_cycles")
def span_tree_cycles(spark, d):
    return traces.span_tree(derived(spark, d, "d_span_cycles")).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "."))


@register(
    "unplaced_spans",
    f"select trace_id, count(*) as unplaced from d_span_cycles s where not exists (select 1 from ({_TREE_SQL.format(t='d_span_cycles')}) t where t.span_id = s.span_id) group by trace_id",
    "d_span_cycles",
)
def unplaced_spans(spark, d):
    return traces.unplaced_count(derived(spark, d, "d_span_cycles"))


_SALVAGE_SQL = f"""with recursive tree as ({_TREE_SQL.format(t='d_span_cycles')}),
seeds as (select trace_id, span_id, parent_span_id, row_number() over (partition by trace_id order by start_time, span_id) as e from d_span_cycles s where not exists (select 1 from tree t where t.span_id = s.span_id)),
walk as (select trace_id, span_id, parent_span_id, e, 0 as depth, [span_id] as seen from seeds
  union all select c.trace_id, c.span_id, c.parent_span_id, w.e, w.depth + 1, list_append(w.seen, c.span_id) from walk w join seeds c on c.trace_id = w.trace_id and c.parent_span_id = w.span_id where not list_contains(w.seen, c.span_id)),
best as (select * from walk qualify row_number() over (partition by trace_id, span_id order by e, depth) = 1)
select trace_id, span_id, cast(depth as integer) as depth, depth = 0 and parent_span_id in (select span_id from seeds) as cycle_point from best"""


@register("salvaged_spans", _SALVAGE_SQL, "d_span_cycles")
def salvaged_spans(spark, d):
    spans = derived(spark, d, "d_span_cycles")
    return traces.salvage(spans, traces.span_tree(spans)).select("trace_id", "span_id", "depth", "cycle_point")


@register(
    "search_spans_matched",
    """select s.trace_id, s.span_id, coalesce(s.status_code = 'Error', false) as matched, s.start_time - min(s.start_time) over (partition by s.trace_id) as offset_ns, s.end_time - s.start_time as duration_ns from d_spans s""",
    "d_spans",
)
def search_spans_matched(spark, d):
    return traces.search_spans(derived(spark, d, "d_spans"), F.col("status_code") == "Error").select("trace_id", "span_id", "matched", "offset_ns", "duration_ns")


@register("error_spans", "select count(*) as n, count(distinct trace_id) as traces from d_spans s where status_code = 'Error' or exists (select 1 from d_events e where e.span_id = s.span_id and e.name = 'exception')", "d_spans", "d_events")
def error_spans(spark, d):
    bad = traces.error_spans(derived(spark, d, "d_spans"), derived(spark, d, "d_events"))
    return bad.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trace_id").alias("traces"))


@register("structural_parents", "select s.span_id, p.span_id as structural_parent from d_spans s left join d_spans p on p.trace_id = s.trace_id and p.span_id = s.parent_span_id", "d_spans")
def structural_parents(spark, d):
    return traces.parent_of(traces.span_tree(derived(spark, d, "d_spans"))).select("span_id", "structural_parent")


@register("linked_traces", "select count(*) as links, count(distinct trace_id) as traces from d_links", "d_links")
def linked_traces(spark, d):
    return derived(spark, d, "d_links").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("trace_id").alias("traces"))


# ---- search ------------------------------------------------------------------------

_SPAN_CASES = {
    "eq": ("name = ECONOMY", "name = 'ECONOMY'"),
    "ne": ("kind != Server", "kind <> 'Server'"),
    "gt": ("duration > 25ms", "end_time - start_time > 25000000"),
    "ge": ("duration >= 25ms", "end_time - start_time >= 25000000"),
    "lt": (f"startTime < {Y97}", f"start_time < {Y97}"),
    "le": (f"endTime <= {Y97}", f"end_time <= {Y97}"),
    "regexp": ("serviceName REGEXP '#0+[1-3]$'", "regexp_matches(service_name, '#0+[1-3]$')"),
    "contains": ("serviceName CONTAINS '0000007'", "service_name like '%0000007%'"),
    "not_contains": ("serviceName NOT CONTAINS '00'", "service_name not like '%00%'"),
    "prefix": ("name ^ PRO", "name like 'PRO%'"),
    "suffix": ("serviceName $ '9'", "service_name like '%9'"),
    "in": ("name IN [ECONOMY, PROMO]", "name in ('ECONOMY', 'PROMO')"),
    "not_in": ("name NOT IN [ECONOMY, PROMO]", "name not in ('ECONOMY', 'PROMO')"),
    "null": ("parentSpanID = NULL", "parent_span_id is null"),
    "not_null": ("parentSpanID != NULL", "parent_span_id is not null"),
    "id": ("traceID = 00000000-0000-0000-0000-000000000001", "trace_id = lpad('1', 32, '0')"),
    "event": ("event.name = exception", "exists (select 1 from d_events e where e.span_id = s.span_id and e.name = 'exception')"),
    "link": ("link.traceID != NULL", "exists (select 1 from d_links l where l.span_id = s.span_id)"),
    "attr_probe": ("part.brand = 'Brand#2'", "brand = 'Brand#2'"),
    "attr_ne": ("part.brand != 'Brand#2'", "brand <> 'Brand#2'"),
    "attr_number": ("line.quantity > 30", "quantity > 30"),
    "attr_in": ("line.quantity IN [1, 2, 3]", "quantity in (1, 2, 3)"),
    "attr_resource": ("service.name = 'Supplier#000000001'", "service_name = 'Supplier#000000001'"),
    "attr_missing": ("no.such != x", "false"),
    "left_to_right": ("name = ECONOMY OR name = PROMO AND kind = Server", "(name = 'ECONOMY' or name = 'PROMO') and kind = 'Server'"),
    "nested": ("kind = Server AND (statusCode = Error OR name = PROMO)", "kind = 'Server' and (status_code = 'Error' or name = 'PROMO')"),
    "everywhere": ("Brand#12", "concat_ws(' ', trace_id, span_id, coalesce(parent_span_id, '')) like '%Brand#12%' or brand like '%Brand#12%' or name like '%Brand#12%' or status_message like '%Brand#12%'"),
}
_SPAN_EXTRA = {
    "part.brand": parser.Field("part.brand", "attribute", "string", "span"),
    "line.quantity": parser.Field("line.quantity", "attribute", "int64", "span"),
    "service.name": parser.Field("service.name", "attribute", "string", "resource"),
    "no.such": parser.Field("no.such", "attribute", "string", "span"),
}


@register("search_span_operators", " union all ".join(f"select '{n}' as case_name, count(*) as hits, count(distinct trace_id) as traces from d_spans s where {w}" for n, (_, w) in _SPAN_CASES.items()), "d_spans", "d_events", "d_links")
def search_span_operators(spark, d):
    spans = derived(spark, d, "d_spans")
    own = fx.spans_with_attributes(spans)
    sources = compiler.Sources(fx.attributes_of(spans).cache(), derived(spark, d, "d_events"), derived(spark, d, "d_links"))
    out = None
    for name, (text, _) in _SPAN_CASES.items():
        tree = parser.parse(text, compiler.SPAN_FIELDS | _SPAN_EXTRA)
        hit = compiler.matching(own, tree, compiler.SPANS, sources).agg(F.lit(name).alias("case_name"), F.count(F.lit(1)).alias("hits"), F.count_distinct("trace_id").alias("traces"))
        out = hit if out is None else out.union(hit)
    return out


_SCOPE_CASES = {
    "event_is": ("exc.code = 3", "exists (select 1 from d_events e where e.span_id = s.span_id and e.timestamp % 7 = 3)"),
    "event_has": ("exc.code CONTAINS 1", "exists (select 1 from d_events e where e.span_id = s.span_id and e.timestamp % 7 = 1)"),
    "event_any": ("exc.code != NULL", "exists (select 1 from d_events e where e.span_id = s.span_id)"),
    "link_is": ("link.rank > 4", "exists (select 1 from d_links l where l.span_id = s.span_id and strlen(l.linked_span_id) > 4 and cast(right(l.linked_span_id, 5) as bigint) // 10000 % 10 > 4)"),
    "resource_has": ('service.name $ 7', "s.service_name like '%7'"),
    "resource_not": ("service.name NOT CONTAINS 1", "s.service_name not like '%1%'"),
    "resource_none": ("no.such = NULL", "true"),
    "free_resource": ("'#000000007'", "s.service_name like '%#000000007%'"),
    "free_event": ("code-5", "exists (select 1 from d_events e where e.span_id = s.span_id and e.timestamp % 7 = 5)"),
    "free_key": ("exc.tag", "exists (select 1 from d_events e where e.span_id = s.span_id)"),
}
_SCOPE_FIELDS = {
    "exc.code": parser.Field("exc.code", "attribute", "string", "event"),
    "link.rank": parser.Field("link.rank", "attribute", "int64", "link"),
    "service.name": parser.Field("service.name", "attribute", "string", "resource"),
    "no.such": parser.Field("no.such", "attribute", "string", "resource"),
}


def _carried(rows, scope, **values):
    """Child rows with ids of the given attributes, and the dictionary of those."""
    kinds = {k.replace("_", "."): (c, t) for k, (c, t) in values.items()}
    entry = F.array(*(F.struct(F.lit(k).alias("key"), c.alias("value"), F.lit(t).alias("type"), F.lit(scope).alias("scope")) for k, (c, t) in kinds.items()))
    with_ids = rows.withColumn("attribute_ids", F.transform(entry, lambda e: ids.attribute_id(e.key, e.value, e.type, e.scope)))
    flat = rows.select(F.explode(entry).alias("e")).select("e.*").distinct()
    return with_ids, flat.select(ids.attribute_id(F.col("key"), F.col("value"), F.col("type"), F.col("scope")).alias("id"), "key", "value", "type", "scope")


@register("search_span_scopes", " union all ".join(f"select '{n}' as case_name, count(*) as hits, count(distinct trace_id) as traces from d_spans s where {w}" for n, (_, w) in _SCOPE_CASES.items()), "d_spans", "d_events", "d_links")
def search_span_scopes(spark, d):
    spans = derived(spark, d, "d_spans")
    code = (F.col("timestamp") % 7).cast("string")
    events, of_events = _carried(derived(spark, d, "d_events"), "event", exc_code=(code, "string"), exc_tag=(F.concat(F.lit("code-"), code), "string"))
    rank = F.floor(F.right("linked_span_id", F.lit(5)).cast("long") / 10000) % 10
    links, of_links = _carried(derived(spark, d, "d_links"), "link", link_rank=(rank.cast("string"), "int64"))
    sources = compiler.Sources(fx.attributes_of(spans).union(of_events).union(of_links).cache(), events, links)
    own = fx.spans_with_attributes(spans)
    out = None
    for name, (text, _) in _SCOPE_CASES.items():
        tree = parser.parse(text, compiler.SPAN_FIELDS | _SCOPE_FIELDS)
        hit = compiler.matching(own, tree, compiler.SPANS, sources).agg(F.lit(name).alias("case_name"), F.count(F.lit(1)).alias("hits"), F.count_distinct("trace_id").alias("traces"))
        out = hit if out is None else out.union(hit)
    return out


_METRIC_CASES = {
    "label_is": ("user = 17", "exists (select 1 from events e where e.event_type = m.id and e.user_id = 17)"),
    "label_more": ("user > 140", "exists (select 1 from events e where e.event_type = m.id and e.user_id > 140)"),
    "exemplar_is": ("hour = 5", "exists (select 1 from events e where e.event_type = m.id and e.value > 400 and @HOUR = 5)"),
    "name": ("name ^ s OR name = click", "m.id like 's%' or m.id = 'click'"),
    "free_label": ("u149", "exists (select 1 from events e where e.event_type = m.id and e.user_id = 149)"),
}


@register("search_metric_scopes", " union all ".join(f"select '{n}' as case_name, m.id from (select distinct event_type as id from events) m where {w}" for n, (_, w) in _METRIC_CASES.items()).replace("@HOUR", "hour(e.ts)"))
def search_metric_scopes(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    points = events.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("metric_ingest_id"), "user_id", "value", "ts")
    labelled, of_points = _carried(points, "datapoint", user=(F.col("user_id").cast("string"), "int64"), label=(F.concat(F.lit("u"), F.col("user_id").cast("string")), "string"))
    marked, of_marks = _carried(points.filter("value > 400").select(F.col("id").alias("datapoint_id"), F.hour("ts").cast("string").alias("h")), "exemplar", hour=(F.col("h"), "int64"))
    sources = compiler.Sources(of_points.union(of_marks).cache(), datapoints=labelled, exemplars=marked)
    ingests = events.select(F.col("event_type").alias("id"), F.col("event_type").alias("name")).distinct()
    fields = compiler.METRIC_FIELDS | {"user": parser.Field("user", "attribute", "int64", "datapoint"), "hour": parser.Field("hour", "attribute", "int64", "exemplar")}
    out = None
    for name, (text, _) in _METRIC_CASES.items():
        hit = compiler.matching(ingests, parser.parse(text, fields), compiler.METRICS, sources).select(F.lit(name).alias("case_name"), "id")
        out = hit if out is None else out.union(hit)
    return out


_LOG_CASES = {
    "severity": ("severityNumber >= 13", "severity_number >= 13"),
    "body": ('body CONTAINS \'"k": 6\'', "body like '%\"k\": 6%'"),
    "text": ("severityText IN [ERROR, WARN]", "severity_text in ('ERROR', 'WARN')"),
    "no_time": ("timestamp = 0", "timestamp = 0"),
    "both": ("eventName = checkout AND serviceName ^ s", "event_name = 'checkout' and service_name like 's%'"),
    "regexp": ("body REGEXP 'k.: 9[0-9]'", "regexp_matches(body, 'k.: 9[0-9]')"),
}


@register("search_log_operators", " union all ".join(f"select '{n}' as case_name, count(*) as hits from d_logs where {w}" for n, (_, w) in _LOG_CASES.items()), "d_logs")
def search_log_operators(spark, d):
    rows = derived(spark, d, "d_logs")
    out = None
    for name, (text, _) in _LOG_CASES.items():
        hit = compiler.matching(rows, parser.parse(text, compiler.LOG_FIELDS), compiler.LOGS).agg(F.lit(name).alias("case_name"), F.count(F.lit(1)).alias("hits"))
        out = hit if out is None else out.union(hit)
    return out


# ---- logs --------------------------------------------------------------------------

_LOG_SQL = "select id, coalesce(nullif(timestamp, 0), observed_timestamp) as effective_time, severity_text, severity_number, service_name, event_name, trace_id, substr(body, 1, 300) as body_preview from d_logs"


@register("search_logs", _LOG_SQL, "d_logs")
def search_logs(spark, d):
    return logs.search_logs(derived(spark, d, "d_logs"))


@register("search_logs_window", f"select * from ({_LOG_SQL}) x where effective_time between {JAN10} and {JAN20} and severity_number >= 13", "d_logs")
def search_logs_window(spark, d):
    return logs.search_logs(derived(spark, d, "d_logs"), JAN10, JAN20, F.col("severity_number") >= 13)


@register("get_log", "select id, body, observed_timestamp from d_logs where id = lpad('42', 12, '0')", "d_logs")
def get_log(spark, d):
    return logs.get_log(derived(spark, d, "d_logs"), "42".zfill(12)).select("id", "body", "observed_timestamp")


@register("log_body_preview", "select doc_id, substr(text, 1, 300) as body_preview, length(substr(text, 1, 300)) as n from documents")
def log_body_preview(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    short = logs.body_preview(F.col("text"))
    return docs.select("doc_id", short.alias("body_preview"), F.length(short).cast("long").alias("n"))


# ---- dictionary --------------------------------------------------------------------

_DICT_SQL = """select distinct 'part.brand' as key, brand as value, 'string' as type, 'span' as scope from d_spans
union select distinct 'line.quantity', cast(quantity as string), 'int64', 'span' from d_spans union select distinct 'service.name', service_name, 'string', 'resource' from d_spans"""
_ID_SQL = "substr(sha256(concat(strlen(key), ':', key, strlen(value), ':', value, strlen(type), ':', type, strlen(scope), ':', scope)), 1, 32)"


@register("attribute_dictionary", f"select {_ID_SQL} as id, key, value, type, scope from ({_DICT_SQL}) x", "d_spans")
def attribute_dictionary(spark, d):
    return fx.attributes_of(derived(spark, d, "d_spans")).withColumn("id", ids.trace_id_wire(F.col("id")))


@register("trace_attributes", f"select distinct key, scope, type from ({_DICT_SQL}) x where scope in ('resource', 'scope', 'span', 'event', 'link')", "d_spans")
def trace_attributes(spark, d):
    return discovery.attributes_of(fx.attributes_of(derived(spark, d, "d_spans")), discovery.TRACE_SCOPES)


@register(
    "search_attributes",
    f"select key, scope, type, count(*) as value_count, array_to_string(list_sort(list(value))[1:3], '|') as samples from ({_DICT_SQL}) x where contains(lower(value), 'd#1') or contains(lower(key), 'd#1') group by all",
    "d_spans",
)
def search_attributes(spark, d):
    return discovery.search_attributes(fx.attributes_of(derived(spark, d, "d_spans")), "D#1").withColumn("samples", F.array_join("samples", "|"))


@register("resolve_attribute", "select span_id, brand as value from d_spans", "d_spans")
def resolve_attribute(spark, d):
    spans = derived(spark, d, "d_spans")
    return discovery.resolve(fx.spans_with_attributes(spans).select("span_id", "attribute_ids"), fx.attributes_of(spans), "part.brand", "span").select("span_id", "value")


@register("attribute_lists", "select span_id, concat('line.quantity=', quantity, '|part.brand=', brand) as labels from d_spans", "d_spans")
def attribute_lists(spark, d):
    spans = derived(spark, d, "d_spans")
    got = discovery.attribute_lists(fx.spans_with_attributes(spans).select("span_id", "attribute_ids"), fx.attributes_of(spans))
    return got.select("span_id", F.array_join(F.transform("attributes", lambda a: F.concat(a.key, F.lit("="), a.value)), "|").alias("labels"))


@register(
    "store_stats",
    """select 'traces' as signal, count(*) as items, count(distinct trace_id) as groups, count(distinct nullif(service_name, '')) as services, count(*) filter (where status_code = 'Error') as errors, max(end_time) as last_received from d_spans
union all select 'logs', count(*), count(distinct trace_id), count(distinct nullif(service_name, '')), count(*) filter (where severity_number >= 17), coalesce(nullif(max(timestamp), 0), max(observed_timestamp)) from d_logs
union all select 'metrics', count(*), count(distinct stream_id), count(distinct series_id), 0, max(timestamp) from d_gauge""",
    "d_spans", "d_logs", "d_gauge",
)
def store_stats(spark, d):
    return discovery.stats(derived(spark, d, "d_spans"), derived(spark, d, "d_logs"), derived(spark, d, "d_gauge"))


# ---- metrics: scalars --------------------------------------------------------------


@register(
    "metric_summaries",
    f"""select stream_id, count(distinct series_id) filter (where timestamp between {JAN10} and {JAN20}) as series_count, count(*) filter (where timestamp between {JAN10} and {JAN20}) as datapoint_count,
  count(distinct series_id) as series_cardinality, max(timestamp) filter (where timestamp between {JAN10} and {JAN20}) as last_seen,
  arg_max(value, (timestamp, id)) filter (where timestamp between {JAN10} and {JAN20}) as last_value from d_gauge group by stream_id""",
    "d_gauge",
)
def metric_summaries(spark, d):
    points = derived(spark, d, "d_gauge")
    streams = points.select(F.col("stream_id").alias("id"), F.lit("Gauge").alias("metric_type")).distinct()
    series = points.select("stream_id", "series_id").distinct()
    return metrics.search_summaries(streams, points, series, start=JAN10, end=JAN20).drop("metric_type")


@register(
    "m4_election",
    f"""select series_id, cast(floor(timestamp / {DAY}) as bigint) * {DAY} as bucket_start, arg_min(id, (timestamp, id)) as first_id, arg_max(id, (timestamp, id)) as last_id, arg_min(id, (value, id)) as min_id, arg_max(id, (value, id)) as max_id
from d_gauge group by 1, 2""",
    "d_gauge",
)
def m4_election(spark, d):
    return metrics.elected(metrics.bucketed(derived(spark, d, "d_gauge"), DAY))


@register(
    "m4_zone",
    f"""select series_id, cast(floor((timestamp + 19800000000000) / {DAY}) as bigint) * {DAY} - 19800000000000 as bucket_start, count(*) as n from d_gauge group by 1, 2""",
    "d_gauge",
)
def m4_zone(spark, d):
    p = metrics.bucketed(derived(spark, d, "d_gauge"), DAY, metrics.Request(tz_name="Asia/Kolkata"))
    return p.groupBy("series_id", "bucket_start").agg(F.count(F.lit(1)).alias("n"))


_DELTA = """lag as (select *, lag(value) over (partition by series_id order by timestamp, id) as prev from d_counter),
dl as (select id, series_id, timestamp, value, case when value < prev then value else value - prev end as delta, value < prev as is_reset from lag)"""


@register("counter_deltas", f"with {_DELTA} select id, series_id, round(delta, 6) as delta, is_reset from dl", "d_counter")
def counter_deltas(spark, d):
    return _rounded(metrics.deltas(derived(spark, d, "d_counter")).select("id", "series_id", "delta", "is_reset"), "delta")


@register(
    "cadence",
    """with g as (select stream_id, series_id, timestamp - lag(timestamp) over (partition by series_id order by timestamp, id) as gap from d_gauge)
select stream_id, round(median(gap), 3) as cadence_ns from (select stream_id, series_id, median(gap) as gap from g where gap > 0 group by 1, 2) x group by 1""",
    "d_gauge",
)
def cadence(spark, d):
    return metrics.cadence(derived(spark, d, "d_gauge"), ("stream_id",)).withColumn("cadence_ns", F.round("cadence_ns", 3))


_VIEWS = f"""{_DELTA}, b as (select *, cast(floor(timestamp / {DAY}) as bigint) * {DAY} as bucket_start from dl),
ends as (select series_id, min(bucket_start) as a, max(bucket_start) as z from b group by 1), spine as (select series_id, unnest(range(a, z + {DAY}, {DAY})) as bucket_start from ends),
v as (select s.series_id, s.bucket_start, count(b.id) as sample_count, sum(b.value) as value_sum, avg(b.value) as value_avg, sum(b.delta) / 86400.0 as rate, coalesce(bool_or(b.is_reset), false) as has_reset
  from spine s left join b on b.series_id = s.series_id and b.bucket_start = s.bucket_start group by 1, 2)"""


@register("metric_views", f"with {_VIEWS} select series_id, bucket_start, sample_count, round(value_sum, 4) as value_sum, round(value_avg, 4) as value_avg, round(rate, 6) as rate, has_reset from v", "d_counter")
def metric_views(spark, d):
    v = metrics.views(derived(spark, d, "d_counter"), DAY)
    return v.withColumns({"value_sum": F.round("value_sum", 4), "value_avg": F.round("value_avg", 4), "rate": F.round("rate", 6)})


_DRAWN = f"{_VIEWS}, dr as (select *, case when sample_count = 0 then 0 else rate end as drawn_rate from v)"


@register(
    "metric_slopes",
    f"""with {_DRAWN} select series_id, bucket_start, round(drawn_rate, 6) as drawn_rate,
  round((drawn_rate - lag(drawn_rate) over w) / ((bucket_start - lag(bucket_start) over w) / 1e9), 9) as slope from dr where drawn_rate is not null window w as (partition by series_id order by bucket_start)""",
    "d_counter",
)
def metric_slopes(spark, d):
    return metrics.slopes(metrics.views(derived(spark, d, "d_counter"), DAY)).withColumns({"drawn_rate": F.round("drawn_rate", 6), "slope": F.round("slope", 9)})


@register("rate_stats", f"with {_DRAWN} select series_id, round(min(drawn_rate), 6) as min_rate, round(max(drawn_rate), 6) as max_rate, round(avg(drawn_rate), 6) as avg_rate from dr where drawn_rate is not null group by 1", "d_counter")
def rate_stats(spark, d):
    return _rounded(metrics.rate_stats(metrics.views(derived(spark, d, "d_counter"), DAY)), "min_rate", "max_rate", "avg_rate")


@register(
    "metric_pools",
    f"""with {_VIEWS}, rows_ as (select 'all' as pool, * from v union all select 'selected', * from v where series_id in ('click:1', 'view:2'))
select pool, bucket_start, cast(sum(sample_count) as bigint) as sample_count, round(sum(value_sum), 3) as value_sum, round(sum(value_sum) / nullif(sum(sample_count), 0), 4) as value_avg, round(sum(rate), 5) as rate, bool_or(has_reset) as has_reset
from rows_ group by 1, 2""",
    "d_counter",
)
def metric_pools(spark, d):
    p = metrics.pools(metrics.views(derived(spark, d, "d_counter"), DAY), ["click:1", "view:2"])
    return p.withColumns({"value_sum": F.round("value_sum", 3), "value_avg": F.round("value_avg", 4), "rate": F.round("rate", 5)})


@register(
    "sparkline",
    f"""with b as (select *, cast(floor(timestamp / {DAY}) as bigint) * {DAY} as bucket from d_gauge)
select series_id, arg_min(timestamp, (value, timestamp)) as timestamp, min(value) as value from b group by series_id, bucket union select series_id, arg_max(timestamp, (value, timestamp)), max(value) from b group by series_id, bucket""",
    "d_gauge",
)
def sparkline(spark, d):
    return metrics.sparkline(derived(spark, d, "d_gauge"), DAY)


@register("series_rank", "select series_id, max(timestamp) as latest, count(*) as datapoint_count, cast(row_number() over (order by max(timestamp) desc, series_id) as integer) as rank from d_gauge group by 1", "d_gauge")
def series_rank(spark, d):
    return metrics.series_rank(derived(spark, d, "d_gauge"))


@register("series_limit", "select series_id, max(timestamp) as latest from d_gauge group by 1 order by 2 desc, 1 limit 7", "d_gauge")
def series_limit(spark, d):
    return metrics.shipped_series(derived(spark, d, "d_gauge"), metrics.Request(datapoint_series_limit=7)).select("series_id", "latest")


@register("series_stats", "select series_id, count(value) as n, min(value) as min_value, max(value) as max_value, round(avg(value), 6) as avg_value, round(sum(value), 6) as sum_value, arg_max(value, (timestamp, id)) as last_value from d_gauge group by 1", "d_gauge")
def series_stats(spark, d):
    return _rounded(metrics.series_stats(derived(spark, d, "d_gauge")), "avg_value", "sum_value")


@register("resampled", f"select series_id, cast(floor(timestamp / {DAY}) as bigint) * {DAY} + {DAY // 2} as centre, arg_max(value, (timestamp, id)) as value from d_gauge group by 1, 2", "d_gauge")
def resampled(spark, d):
    return metrics.resampled(derived(spark, d, "d_gauge"), DAY)


_LADDER_SQL = "[" + ", ".join(f"{w}::bigint" for w in buckets.LADDER) + "]"


@register("bucket_ladder", f"select event_id, coalesce(list_min(list_filter({_LADDER_SQL}, lambda w: (event_id * 7919000001) // w <= 1 + event_id % 400)), cast((event_id * 7919000001 / {DAY} / (1 + event_id % 400) + 1) * {DAY} as bigint)) as width from events where event_id > 0")
def bucket_ladder(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_id > 0")
    return e.select("event_id", buckets.width_column(F.col("event_id") * 7919000001, 1 + F.col("event_id") % 400).alias("width"))


@register(
    "zone_offsets",
    """select event_id, zone, (epoch_us(make_timestamptz(us) at time zone zone) - us) * 1000 as offset_ns from (select event_id, event_id * 3154000000 + 1700000000000000 as us from events) x, (values ('UTC'), ('Asia/Kolkata'), ('Europe/London'), ('America/New_York')) z(zone)""",
)
def zone_offsets(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.timestamp_micros(F.col("event_id") * 3154000000 + 1700000000000000).alias("t"))
    out = None
    for z in ("UTC", "Asia/Kolkata", "Europe/London", "America/New_York"):
        part = e.select("event_id", F.lit(z).alias("zone"), buckets.zone_offset_at(F.col("t"), z).alias("offset_ns"))
        out = part if out is None else out.union(part)
    return out


@register(
    "local_to_utc",
    """select event_id, zone, epoch_us(make_timestamp(us) at time zone zone) * 1000 as utc_ns from (select event_id, event_id * 900000000 + 1767225600000000 as us from events) x, (values ('Asia/Kolkata'), ('Europe/London'), ('America/New_York')) z(zone)""",
)
def local_to_utc(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") * 900000000000 + 1767225600000000000).alias("ns"))
    out = None
    for z in ("Asia/Kolkata", "Europe/London", "America/New_York"):
        part = e.select("event_id", F.lit(z).alias("zone"), buckets.to_utc(F.col("ns"), z).alias("utc_ns"))
        out = part if out is None else out.union(part)
    return out


# ---- metrics: histograms -----------------------------------------------------------

WEEK = 7 * DAY
_WEEK = f"cast(floor(timestamp / {WEEK}) as bigint) * {WEEK}"
_H5 = ", ".join(f"cast(sum(c{i}) as bigint) as c{i}" for i in range(5))


def _flat(df: DataFrame) -> DataFrame:
    cells = [F.coalesce(F.get("bucket_counts", F.lit(i)), F.lit(0)).alias(f"c{i}") for i in range(5)]
    return df.select(*(c for c in df.columns if c not in ("bucket_counts", "explicit_bounds", "quantiles")), *cells)


@register("hist_merge_delta", f"select series_id, {_WEEK} as bucket_start, arg_max(id, (timestamp, id)) as id, min(start_time) as start_time, cast(sum(count) as bigint) as count, round(sum(sum), 4) as sum, {_H5} from d_hist_delta group by 1, 2", "d_hist_delta")
def hist_merge_delta(spark, d):
    p = metrics.bucketed(fx.explicit_points(spark, d, "d_hist_delta"), WEEK)
    return _flat(metrics.merge_explicit(p).drop("distinct_bounds")).withColumn("sum", F.round("sum", 4))


@register(
    "hist_merge_cumulative",
    f"""select series_id, {_WEEK} as bucket_start, cast(sum(count) as bigint) as count, round(sum(sum), 4) as sum, {_H5} from (select *, row_number() over (partition by series_id order by timestamp, id) as rn from d_hist_delta) x where rn > 1 group by 1, 2""",
    "d_hist_delta",
)
def hist_merge_cumulative(spark, d):
    """Cumulative readings must give back the delta totals, less each series' first reading."""
    p = metrics.bucketed(fx.explicit_points(spark, d, "d_hist_cum"), WEEK)
    return _flat(metrics.merge_explicit(p, cumulative=True).drop("distinct_bounds", "id", "start_time")).withColumn("sum", F.round("sum", 4))


_LO, _HI = "[10.0, 10.0, 50.0, 100.0, 250.0]", "[10.0, 50.0, 100.0, 250.0, 250.0]"


@register(
    "hist_quantiles",
    f"""with m as (select series_id, {_WEEK} as bucket_start, {_H5} from d_hist_delta group by 1, 2), cells as (select *, [c0, c1, c2, c3, c4] as c, c0 + c1 + c2 + c3 + c4 as n from m),
x as (select series_id, bucket_start, c, n, unnest(range(1, 6)) as i from cells), a as (select *, c[i] as cnt, coalesce(list_sum(c[1:i-1]), 0) as before, list_sum(c[1:i]) as acc from x),
qs as (select * from a, (values (0.5), (0.95), (0.99)) q(q))
select series_id, bucket_start, cast(q as double) as q, round(arg_min({_LO}[i] + ({_HI}[i] - {_LO}[i]) * (q * n - before) / cnt, i), 6) as value from qs where cnt > 0 and acc >= q * n group by 1, 2, 3""",
    "d_hist_delta",
)
def hist_quantiles(spark, d):
    p = metrics.bucketed(fx.explicit_points(spark, d, "d_hist_delta"), WEEK)
    return _rounded(metrics.quantile_lines(metrics.with_quantiles(metrics.merge_explicit(p), [0.5, 0.95, 0.99], False)), "value")


@register(
    "hist_extents",
    f"""with m as (select series_id, {_WEEK} as bucket_start, {_H5} from d_hist_delta group by 1, 2)
select series_id, bucket_start, case when c0 > 0 or c1 > 0 then 10.0 when c2 > 0 then 50.0 when c3 > 0 then 100.0 else 250.0 end::double as min, case when c4 > 0 or c3 > 0 then 250.0 when c2 > 0 then 100.0 when c1 > 0 then 50.0 else 10.0 end::double as max from m""",
    "d_hist_delta",
)
def hist_extents(spark, d):
    p = metrics.bucketed(fx.explicit_points(spark, d, "d_hist_delta"), WEEK)
    return metrics.with_extents(metrics.merge_explicit(p), False).select("series_id", "bucket_start", "min", "max")


_ODD = "user_id % 50 = 0 and day % 2 = 1"


@register(
    "hist_bounds_mismatch",
    f"""with m as (select series_id, {_WEEK} as bucket_start, count(distinct case when {_ODD} then 1 else 0 end) as b from d_hist_delta group by 1, 2) select count(*) as refused_rows, count(distinct bucket_start) as refused_buckets from m where b > 1""",
    "d_hist_delta",
)
def hist_bounds_mismatch(spark, d):
    p = metrics.bucketed(fx.explicit_points(spark, d, "d_hist_delta", odd_bounds=True), WEEK)
    return metrics.bounds_mismatch(metrics.merge_explicit(p))


@register("hist_cross_series", f"select {_WEEK} as bucket_start, cast(sum(count) as bigint) as count, round(sum(sum), 3) as sum, {_H5} from d_hist_delta group by 1", "d_hist_delta")
def hist_cross_series(spark, d):
    p = metrics.bucketed(fx.explicit_points(spark, d, "d_hist_delta"), WEEK)
    return _flat(metrics.cross_series_explicit(metrics.merge_explicit(p)).select("bucket_start", "count", "sum", "bucket_counts")).withColumn("sum", F.round("sum", 3))


_EXP = f"""cells as (select event_type || ':' || user_id as series_id, cast(floor(day / 7) as bigint) * {WEEK} as bucket_start, scale, idx, c from d_exp_cells),
t as (select *, min(scale) over (partition by series_id, bucket_start) as ts from cells),
dn as (select series_id, bucket_start, ts, case when idx is null then null else idx >> cast(scale - ts as integer) end as i, c from t),
cut as (select *, cast(floor(log2(0.05) * power(2, ts)) as bigint) - 1 as cutoff from dn)"""


@register(
    "exphist_merge",
    f"with {_EXP} select series_id, bucket_start, cast(ts as integer) as scale, i as idx, cast(sum(c) as bigint) as c from cut where i > cutoff group by 1, 2, 3, 4",
    "d_exp_cells",
)
def exphist_merge(spark, d):
    m = metrics.merge_exponential(metrics.bucketed(fx.exponential_points(spark, d), WEEK))
    cells = m.select("series_id", "bucket_start", "scale", "positive_bucket_offset", F.posexplode("positive_bucket_counts").alias("p", "c"))
    return cells.filter("c > 0").select("series_id", "bucket_start", "scale", (F.col("positive_bucket_offset") + F.col("p")).alias("idx"), "c")


@register(
    "exphist_zero",
    f"with {_EXP} select series_id, bucket_start, cast(sum(c) as bigint) as count, cast(sum(case when i is null or i <= cutoff then c else 0 end) as bigint) as zero_count from cut group by 1, 2",
    "d_exp_cells",
)
def exphist_zero(spark, d):
    return metrics.merge_exponential(metrics.bucketed(fx.exponential_points(spark, d), WEEK)).select("series_id", "bucket_start", "count", "zero_count")


@register(
    "exphist_quantiles",
    f"""with {_EXP}, z as (select series_id, bucket_start, ts, case when i is null or i <= cutoff then -999999 else i end as i, sum(c) as cnt from cut group by 1, 2, 3, 4),
a as (select *, coalesce(sum(cnt) over (w rows between unbounded preceding and 1 preceding), 0) as before, sum(cnt) over (w rows between unbounded preceding and current row) as acc, sum(cnt) over (partition by series_id, bucket_start) as n from z window w as (partition by series_id, bucket_start order by i)),
q as (select *, arg_min(i, i) over (partition by series_id, bucket_start) as dummy from a where acc >= 0.9 * n)
select series_id, bucket_start, 0.9::double as q, round(arg_min(case when i = -999999 then 0.0 else power(2, power(2, -ts) * i) * power(power(2, power(2, -ts) * (i + 1)) / power(2, power(2, -ts) * i), (0.9 * n - before) / cnt) end, i), 6) as value from q group by 1, 2""",
    "d_exp_cells",
)
def exphist_quantiles(spark, d):
    m = metrics.merge_exponential(metrics.bucketed(fx.exponential_points(spark, d), WEEK))
    return _rounded(metrics.quantile_lines(metrics.with_quantiles(m, [0.9], True)), "value")


_SIGNED = f"""cells as (select *, min(day) over (partition by series_id) as first from d_sign_cells), d as (select series_id, cast(floor(day / 7) as bigint) * {WEEK} as bucket_start, side, idx, c from cells where day > first)"""


@register(
    "exphist_cumulative",
    f"with {_SIGNED} select series_id, bucket_start, side, case when side = 'zero' then 0 else idx end as idx, cast(sum(c) as bigint) as c from d group by 1, 2, 3, 4",
    "d_sign_cells",
)
def exphist_cumulative(spark, d):
    m = metrics.merge_exponential(metrics.bucketed(fx.cumulative_exponential_points(spark, d), WEEK), cumulative=True)
    cells = None
    for side in ("positive", "negative"):
        x = m.select("series_id", "bucket_start", F.lit(side).alias("side"), F.col(f"{side}_bucket_offset").alias("o"), F.posexplode(f"{side}_bucket_counts").alias("p", "c"))
        x = x.select("series_id", "bucket_start", "side", (F.col("o") + F.col("p")).alias("idx"), "c")
        cells = x if cells is None else cells.union(x)
    return cells.union(m.select("series_id", "bucket_start", F.lit("zero"), F.lit(0).cast("long"), "zero_count")).filter("c > 0")


@register(
    "exphist_negative_quantiles",
    f"""with {_SIGNED}, z as (select series_id, bucket_start, case side when 'zero' then 0 when 'positive' then 1000 + idx else -1000 - idx end as pos, side, idx, sum(c) as cnt from d group by 1, 2, 3, 4, 5),
a as (select *, coalesce(sum(cnt) over (w rows between unbounded preceding and 1 preceding), 0) as before, sum(cnt) over (w rows between unbounded preceding and current row) as acc, sum(cnt) over (partition by series_id, bucket_start) as n from z window w as (partition by series_id, bucket_start order by pos)),
q as (select *, case side when 'negative' then -power(2, (idx + 1) / 4.0) when 'positive' then power(2, idx / 4.0) else 0 end as lo, case side when 'negative' then -power(2, idx / 4.0) when 'positive' then power(2, (idx + 1) / 4.0) else 0 end as hi from a where acc >= 0.25 * n)
select series_id, bucket_start, 0.25::double as q, round(arg_min(case when side = 'zero' then 0.0 else lo * power(hi / lo, (0.25 * n - before) / cnt) end, pos), 5) as value from q group by 1, 2""",
    "d_sign_cells",
)
def exphist_negative_quantiles(spark, d):
    m = metrics.merge_exponential(metrics.bucketed(fx.cumulative_exponential_points(spark, d), WEEK), cumulative=True)
    return metrics.quantile_lines(metrics.with_quantiles(m, [0.25], True)).withColumn("value", F.round("value", 5)).filter("value is not null")


_EXEMPLARS = f"select id as id, concat(series_id, ':', cast(cast(floor(timestamp / {DAY}) as bigint) as string)) as datapoint_id, series_id, timestamp, value from d_gauge"


@register(
    "exemplar_caps",
    f"""with e as ({_EXEMPLARS}), r as (select *, row_number() over (partition by datapoint_id order by value, id) as u, row_number() over (partition by datapoint_id order by value desc, id) as v, count(*) over (partition by datapoint_id) as exemplar_count from e),
k as (select *, row_number() over (partition by datapoint_id order by least(u, v), id) as rank from r) select id, datapoint_id, cast(rank as integer) as rank, exemplar_count from k where rank <= 5""",
    "d_gauge",
)
def exemplar_caps(spark, d):
    e = derived(spark, d, "d_gauge").select("id", F.concat_ws(":", "series_id", buckets.floor_div(F.col("timestamp"), DAY).cast("string")).alias("datapoint_id"), "value")
    return metrics.ranked_exemplars(e).select("id", "datapoint_id", "rank", "exemplar_count")


@register(
    "exemplar_carriers",
    f"""with x as (select id, series_id, {_WEEK} as bucket_start, value as low, value as high from d_gauge where value > 400 or value < 20),
r as (select *, least(row_number() over (partition by series_id, bucket_start order by low, id), row_number() over (partition by series_id, bucket_start order by high desc, id)) as e from x),
k as (select *, row_number() over (partition by series_id, bucket_start order by e, id) as rank from r) select id, series_id, bucket_start from k where rank <= 2""",
    "d_gauge",
)
def exemplar_carriers(spark, d):
    p = metrics.bucketed(derived(spark, d, "d_gauge"), WEEK)
    e = p.filter("value > 400 or value < 20").select(F.concat(F.lit("e"), "id").alias("id"), F.col("id").alias("datapoint_id"), "value")
    return metrics.carriers(p, e)


@register(
    "m4_retained",
    f"""with b as (select *, cast(floor(timestamp / {WEEK}) as bigint) as w from d_gauge),
e as (select arg_min(id, (timestamp, id)) as a, arg_max(id, (timestamp, id)) as b, arg_min(id, (value, id)) as c, arg_max(id, (value, id)) as d from b group by series_id, w) select distinct unnest([a, b, c, d]) as id from e""",
    "d_gauge",
)
def m4_retained(spark, d):
    return metrics.retained(metrics.bucketed(derived(spark, d, "d_gauge"), WEEK))


@register(
    "representative_ingest",
    """with p as (select *, concat(stream_id, '/', cast(cast(id as bigint) % 3 as string)) as metric_ingest_id from d_gauge), l as (select stream_id, metric_ingest_id, max(timestamp) as latest from p group by 1, 2)
select stream_id, arg_max(metric_ingest_id, (latest, metric_ingest_id)) as ingest_id, concat('about ', arg_max(metric_ingest_id, (latest, metric_ingest_id))) as description from l group by 1""",
    "d_gauge",
)
def representative_ingest(spark, d):
    p = derived(spark, d, "d_gauge").withColumn("metric_ingest_id", F.concat_ws("/", "stream_id", (F.col("id").cast("long") % 3).cast("string")))
    ingests = p.select(F.col("metric_ingest_id").alias("id"), "stream_id", F.concat(F.lit("about "), "metric_ingest_id").alias("description")).distinct()
    return metrics.representative_ingest(ingests, p)


@register("series_labels", "select 'event_type' as key, count(distinct event_type) as \"values\", count(distinct event_type || ':' || user_id) as series from events union all select 'user', count(distinct user_id), count(distinct event_type || ':' || user_id) from events")
def series_labels(spark, d):
    """Keys that tell series apart; one that all share with one value is left out."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("series_id", F.concat_ws(":", "event_type", "user_id"))
    pairs = F.explode(F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("host"), F.lit("one")))
    return metrics.distinguishing(e.select("series_id", pairs.alias("key", "value")).distinct())


@register(
    "exphist_cross_series",
    f"""with cells as (select cast(floor(day / 7) as bigint) * {WEEK} as bucket_start, scale, idx, c from d_exp_cells), t as (select *, min(scale) over (partition by bucket_start) as ts from cells)
select bucket_start, cast(ts as integer) as scale, idx >> cast(scale - ts as integer) as idx, cast(sum(c) as bigint) as c from t where idx is not null and (idx >> cast(scale - ts as integer)) > cast(floor(log2(0.05) * power(2, ts)) as bigint) - 1 group by 1, 2, 3""",
    "d_exp_cells",
)
def exphist_cross_series(spark, d):
    m = metrics.cross_series_exponential(metrics.merge_exponential(metrics.bucketed(fx.exponential_points(spark, d), WEEK)))
    cells = m.select("bucket_start", "scale", "positive_bucket_offset", F.posexplode("positive_bucket_counts").alias("p", "c"))
    return cells.filter("c > 0").select("bucket_start", "scale", (F.col("positive_bucket_offset") + F.col("p")).alias("idx"), "c")


@register(
    "metric_activity",
    f"""with {_DELTA} select series_id, cast(floor(timestamp / {WEEK}) as bigint) * {WEEK} as bucket_start, round(sum(delta), 4) as activity, count(*) filter (where is_reset) as resets from dl group by 1, 2""",
    "d_counter",
)
def metric_activity(spark, d):
    p = metrics.bucketed(metrics.deltas(derived(spark, d, "d_counter")), WEEK)
    return p.groupBy("series_id", "bucket_start").agg(F.round(F.sum("delta"), 4).alias("activity"), F.count_if("is_reset").alias("resets"))


# ---- mutations and retention -------------------------------------------------------


@register("delete_trace", "select count(*) as spans, (select count(*) from d_events where trace_id <> lpad('1', 32, '0')) as events from d_spans where trace_id <> lpad('1', 32, '0')", "d_spans", "d_events")
def delete_trace(spark, d):
    tables = {"spans": derived(spark, d, "d_spans"), "events": derived(spark, d, "d_events")}
    left = retention.delete_traces(tables, ["1".zfill(32)])
    return left["spans"].agg(F.count(F.lit(1)).alias("spans")).crossJoin(left["events"].agg(F.count(F.lit(1)).alias("events")))


@register("retention_cutoff", "select cast(round(quantile_cont(cast(start_time as double), 0.1)) as bigint) // 1000000 as cutoff_ms, (select cast(round(quantile_cont(cast(timestamp as double), 0.1)) as bigint) // 1000000 from d_gauge) as points_ms from d_spans", "d_spans", "d_gauge")
def retention_cutoff(spark, d):
    a = retention.cutoff(derived(spark, d, "d_spans"), F.col("start_time"))
    b = retention.cutoff(derived(spark, d, "d_gauge"), F.col("timestamp"))
    return spark.range(1).select(F.lit(a // 1000000).alias("cutoff_ms"), F.lit(b // 1000000).alias("points_ms"))


@register("orphan_sweep", f"select key, count(*) as n from ({_DICT_SQL.replace('from d_spans', 'from d_spans where k % 3 = 0')}) x where scope = 'span' group by 1", "d_spans")
def orphan_sweep(spark, d):
    spans = fx.spans_with_attributes(derived(spark, d, "d_spans"))
    tables = {"spans": spans.filter("k % 3 = 0"), "attributes": fx.attributes_of(spans)}
    return retention.sweep(tables)["attributes"].groupBy("key").agg(F.count(F.lit(1)).alias("n"))


# ---- ingest ------------------------------------------------------------------------


def _documents(rows, signal, body):
    """Export documents of one record each, as text and read back, with a resource named by ``service_name``."""
    named = F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service_name").alias("stringValue")).alias("value")))
    outer, inner, items = {"traces": ("resourceSpans", "scopeSpans", "spans"), "logs": ("resourceLogs", "scopeLogs", "logRecords"), "metrics": ("resourceMetrics", "scopeMetrics", "metrics")}[signal]
    scope = F.struct(F.struct(F.lit("lib").alias("name"), F.lit("1").alias("version")).alias("scope"), F.array(body).alias(items))
    text = F.to_json(F.struct(F.array(F.struct(F.struct(named.alias("attributes")).alias("resource"), F.array(scope).alias(inner))).alias(outer)))
    return rows.select(F.from_json(text, {"traces": otlp.TRACES, "logs": otlp.LOGS, "metrics": otlp.METRICS}[signal]).alias("d")).select("d.*")


def _labels(**values):
    value = lambda kind, c: F.struct(*((c if x == kind else F.lit(None).cast("string")).alias(x) for x in ("stringValue", "intValue")))
    return F.array(*(F.struct(F.lit(k).alias("key"), value(kind, c).alias("value")) for k, (kind, c) in values.items()))


def _fields(**values):
    return F.struct(*(c.alias(n) for n, c in values.items()))


@register(
    "ingest_spans",
    """select s.trace_id, s.span_id, s.parent_span_id, s.name, s.kind, s.start_time, s.end_time, s.status_code, s.status_message, s.service_name, 2 as n_attributes, (select count(*) from d_events e where e.span_id = s.span_id) as n_events from d_spans s""",
    "d_spans",
    "d_events",
)
def ingest_spans(spark, d):
    s = derived(spark, d, "d_spans")
    happened = F.when(F.col("line") % 2 == 1, F.array(_fields(name=F.col("status_code"), timeUnixNano=(F.col("start_time") + 10).cast("string"))))
    body = _fields(
        traceId=F.col("trace_id"), spanId=F.col("span_id"), parentSpanId=F.coalesce("parent_span_id", F.lit("")), name=F.col("name"), kind=F.when(F.col("kind") == "Server", "2").otherwise("1"),
        startTimeUnixNano=F.col("start_time").cast("string"), endTimeUnixNano=F.col("end_time").cast("string"), status=_fields(code=F.when(F.col("status_code") == "Error", "2").otherwise("1"), message=F.col("status_message")),
        attributes=_labels(brand=("stringValue", F.col("brand")), quantity=("intValue", F.col("quantity").cast("string"))), events=happened,
    )
    t = otlp.TABLES["traces"](_documents(s, "traces", body))
    n = t["events"].groupBy("span_id").agg(F.count(F.lit(1)).alias("n_events"))
    out = t["spans"].join(n, "span_id", "left").withColumn("n_attributes", F.size("attribute_ids")).withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("long")))
    return out.select("trace_id", "span_id", "parent_span_id", "name", "kind", "start_time", "end_time", "status_code", "status_message", "service_name", "n_attributes", "n_events")


@register(
    "ingest_logs",
    "select timestamp, observed_timestamp, severity_text, cast(severity_number as integer) as severity_number, body, body_type, event_name, service_name, trace_id from d_logs",
    "d_logs",
)
def ingest_logs(spark, d):
    rows = derived(spark, d, "d_logs")
    body = _fields(
        timeUnixNano=F.col("timestamp").cast("string"), observedTimeUnixNano=F.col("observed_timestamp").cast("string"), severityText=F.col("severity_text"), severityNumber=F.col("severity_number"), eventName=F.col("event_name"),
        body=_fields(stringValue=F.col("body")), traceId=F.col("trace_id"),
    )
    t = otlp.TABLES["logs"](_documents(rows, "logs", body))["logs"]
    return t.select("timestamp", "observed_timestamp", "severity_text", "severity_number", "body", "body_type", "event_name", "service_name", "trace_id")


@register(
    "ingest_metrics",
    """select 'gauge' as name, 'Gauge' as metric_type, event_type as service_name, @US(ts) * 1000 as timestamp, value as double_value, null::bigint as int_value, 'double' as value_type, null::bigint as count, case when value > 400 then value end as exemplar from events
union all select 'sum', 'Sum', event_type, @US(ts) * 1000, null, event_id, 'int', null, null from events union all select 'hist', 'Histogram', event_type, @US(ts) * 1000, null, null, null, 3, null from events""".replace("@US(ts)", "epoch_us(ts)"),
)
def ingest_metrics(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("service_name"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("t"), "value", "event_id", "user_id")
    at = F.col("t")
    user = _labels(user=("intValue", F.col("user_id").cast("string")))
    seen = F.when(F.col("value") > 400, F.array(_fields(timeUnixNano=at, asDouble=F.col("value"), filteredAttributes=user)))
    kinds = (
        _fields(name=F.lit("gauge"), gauge=_fields(dataPoints=F.array(_fields(timeUnixNano=at, asDouble=F.col("value"), attributes=user, exemplars=seen)))),
        _fields(name=F.lit("sum"), sum=_fields(dataPoints=F.array(_fields(timeUnixNano=at, asInt=F.col("event_id").cast("string"), attributes=user)), aggregationTemporality=F.lit("1"), isMonotonic=F.lit(False))),
        _fields(name=F.lit("hist"), histogram=_fields(dataPoints=F.array(_fields(timeUnixNano=at, count=F.lit("3"), sum=F.col("value"), bucketCounts=F.array(F.lit("1"), F.lit("2")), explicitBounds=F.array(F.lit(10.0)), attributes=user)), aggregationTemporality=F.lit("1"))),
    )
    out = None
    for body in kinds:
        t = otlp.TABLES["metrics"](_documents(e, "metrics", body))
        x = t["exemplars"].select(F.col("datapoint_id").alias("id"), F.col("value").alias("exemplar"))
        p = t["datapoints"].join(t["metric_streams"].select(F.col("id").alias("stream_id"), "name", "metric_type", "service_name"), "stream_id").join(x, "id", "left")
        p = p.select("name", "metric_type", "service_name", "timestamp", "double_value", "int_value", "value_type", "count", "exemplar")
        out = p if out is None else out.unionByName(p)
    return out


# ---- id rules ----------------------------------------------------------------------


@register("series_ids", "select event_id, substr(sha256(concat(strlen(s), ':', s, strlen(r), ':', r, '1:', 'x')), 1, 32) as id from (select event_id, event_type as s, cast(user_id as string) as r from events) x")
def series_ids(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", ids.trace_id_wire(ids.content_id(F.col("event_type"), F.col("user_id"), F.lit("x"))).alias("id"))


@register("downscale_cells", "select i, l, i >> l as out from (select cast(event_id - 5000 as bigint) as i, cast(event_id % 5 as integer) as l from events) x")
def downscale_cells(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") - 5000).alias("i"), (F.col("event_id") % 5).cast("int").alias("l"))
    return e.select("i", "l", hist.downscaled_offset(F.col("i"), F.col("l")).alias("out"))
