"""Telemetry-shaped tables derived from the star-schema test data.

Each derivation is one SQL text that both engines run; ``@US(x)`` stands for the epoch
microseconds of a timestamp. The oracle puts the same texts in front of its statements.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.functions import ids

BASE = ("lineitem", "orders", "part", "supplier", "events", "documents")

_SPAN_ROWS = """
select l.l_orderkey as k, row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice) as n,
  l.l_linenumber as line, @US(l.l_shipdate) * 1000 as ship, cast(l.l_quantity as bigint) as quantity, l.l_returnflag as flag,
  coalesce(p.p_type, 'NONE') as p_type, coalesce(p.p_brand, 'NONE') as p_brand, coalesce(s.s_name, '') as s_name
from lineitem l left join part p on p.p_partkey = l.l_partkey left join supplier s on s.s_suppkey = l.l_suppkey
"""


def _spans(cycles: bool) -> str:
    ring = "when n = 2 and k % 101 = 0 then @SPAN(3) when n = 3 and k % 101 = 0 then @SPAN(2)" if cycles else ""
    text = f"""
select lpad(cast(k as string), 32, '0') as trace_id, @SPAN(n) as span_id,
  case when n = 1 then null {ring} when n = 2 and k % 17 = 0 then @SPAN(9999) else @SPAN(cast(floor(n / 2.0) as bigint)) end as parent_span_id,
  p_type as name, case when n = 1 then 'Server' else 'Internal' end as kind, ship + n as start_time, ship + n + quantity * 1000000 as end_time,
  case when flag = 'R' then 'Error' else 'Ok' end as status_code, case when flag = 'R' then 'returned' else '' end as status_message,
  s_name as service_name, p_brand as brand, quantity, line, k, n
from d_span_rows"""
    return re.sub(r"@SPAN\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", r"lpad(cast(k * 10000 + \1 as string), 16, '0')", text)


_GRID = "select event_type, user_id, event_id, value, @US(ts) * 1000 as t, cast(floor(@US(ts) / 86400000000) as bigint) as day from events"

DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "d_span_rows": ((), _SPAN_ROWS),
    "d_spans": (("d_span_rows",), _spans(False)),
    "d_span_cycles": (("d_span_rows",), _spans(True)),
    "d_events": (("d_spans",), "select span_id, trace_id, case when status_code = 'Error' then 'exception' else 'log' end as name, start_time + 10 as timestamp from d_spans where line % 2 = 1"),
    "d_links": (("d_spans",), "select b.span_id, a.trace_id, a.span_id as linked_span_id from d_spans a join d_spans b on b.k = a.k + 1 and a.n = 1 and b.n = 1"),
    "d_logs": (
        (),
        """select lpad(cast(event_id as string), 12, '0') as id, case when event_id % 10 = 0 then 0 else @US(ts) * 1000 end as timestamp, @US(ts) * 1000 + 100000000 as observed_timestamp,
  case when event_type = 'error' then 17 when event_type = 'signup' then 13 else 9 end as severity_number, case when event_type = 'error' then 'ERROR' when event_type = 'signup' then 'WARN' else 'INFO' end as severity_text,
  props as body, 'string' as body_type, event_type as service_name, case when event_id % 7 = 0 then 'checkout' else '' end as event_name, lpad(cast(user_id as string), 32, '0') as trace_id, user_id from events""",
    ),
    "d_grid": ((), _GRID),
    "d_gauge": (
        ("d_grid",),
        "select lpad(cast(event_id as string), 12, '0') as id, event_type as stream_id, concat(event_type, ':', cast(user_id as string)) as series_id, t as timestamp, value from d_grid",
    ),
    "d_counter": (
        ("d_grid",),
        """select lpad(cast(event_id as string), 12, '0') as id, event_type as stream_id, concat(event_type, ':', cast(user_id as string)) as series_id, t as timestamp,
  round(sum(value) over (partition by event_type, user_id, run order by t, event_id rows between unbounded preceding and current row), 6) as value
from (select *, cast(floor((row_number() over (partition by event_type, user_id order by t, event_id) - 1) / 40) as bigint) as run from d_grid) x""",
    ),
    "d_hist_delta": (
        ("d_grid",),
        """select concat(event_type, ':', cast(user_id as string), ':', cast(day as string)) as id, event_type as stream_id, concat(event_type, ':', cast(user_id as string)) as series_id,
  day * 86400000000000 as timestamp, day * 86400000000000 - 86400000000000 as start_time, day,
  sum(case when value <= 10 then 1 else 0 end) as c0, sum(case when value > 10 and value <= 50 then 1 else 0 end) as c1, sum(case when value > 50 and value <= 100 then 1 else 0 end) as c2,
  sum(case when value > 100 and value <= 250 then 1 else 0 end) as c3, sum(case when value > 250 then 1 else 0 end) as c4, count(*) as count, round(sum(value), 6) as sum, user_id
from d_grid group by event_type, user_id, day""",
    ),
    "d_hist_cum": (
        ("d_hist_delta",),
        """select id, stream_id, series_id, timestamp, start_time, day, user_id, sum(c0) over w as c0, sum(c1) over w as c1, sum(c2) over w as c2, sum(c3) over w as c3, sum(c4) over w as c4,
  sum(count) over w as count, round(sum(sum) over w, 6) as sum from d_hist_delta window w as (partition by series_id order by timestamp, id rows between unbounded preceding and current row)""",
    ),
    "d_exp_cells": (
        ("d_grid",),
        """select event_type, user_id, day, 2 + day % 2 as scale, case when value < 0.05 then null else cast(floor(log2(value) * power(2, 2 + day % 2)) as bigint) end as idx, count(*) as c
from d_grid group by 1, 2, 3, 4, 5""",
    ),
}


DERIVED["d_sign_cells"] = (
    ("d_grid",),
    """select concat(event_type, ':', cast(user_id as string)) as series_id, day, case when abs(value - 100) < 0.05 then 'zero' when value > 100 then 'positive' else 'negative' end as side,
  case when abs(value - 100) < 0.05 then 0 else cast(floor(round(log2(abs(value - 100)) * 4, 9)) as bigint) end as idx, count(*) as c from d_grid group by 1, 2, 3, 4""",
)


def sql_for(names: tuple[str, ...], duck: bool) -> list[tuple[str, str]]:
    """The derivations that ``names`` need, in order."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in out or name not in DERIVED:
            return
        needs, text = DERIVED[name]
        for n in needs:
            add(n)
        out[name] = text.replace("@US(", "epoch_us(" if duck else "to_us(")

    for n in names:
        add(n)
    return list(out.items())


def oracle(body: str, *names: str) -> str:
    """A DuckDB statement over derived tables."""
    parts = ", ".join(f"{n} as ({text})" for n, text in sql_for(names, True))
    body = body.strip()
    word = "with recursive" if "recursive" in body.lower() else "with"
    if body.lower().startswith("with "):
        body = ("," if parts else word) + body[14 if body.lower().startswith("with recursive ") else 4 :]
    return f"{word} {parts} {body}" if parts else body


WRITTEN: dict[tuple[str, str], str] = {}  # derived tables that were written beforehand, by data folder and name


def write_derived(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write all derived tables, so that queries are timed without their derivation."""
    for name in DERIVED:
        derived(spark, sf_dir, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        WRITTEN[(sf_dir, name)] = f"{folder}/{name}"


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a DataFrame."""
    if (sf_dir, name) in WRITTEN:
        return spark.read.parquet(WRITTEN[(sf_dir, name)])
    frames: dict[str, DataFrame] = {}
    for n, text in sql_for((name,), False):
        text = re.sub(r"to_us\(((?:[^()]|\([^()]*\))*)\)", r"unix_micros(cast(\1 as timestamp))", text)
        used = [t for t in (*BASE, *frames) if re.search(rf"\b(from|join) {t}\b", text)]
        for t in used:
            if t not in frames:
                frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            text = re.sub(rf"\b(from|join) {t}\b(?! as)", rf"\1 {{{t}}}", text)
        frames[n] = spark.sql(text, **{t: frames[t] for t in used})
    return frames[name]


@cache
def _attribute_columns() -> tuple[tuple[str, str, str, str], ...]:
    """(table column, key, type, scope) of the attributes that spans carry."""
    return (("brand", "part.brand", "string", "span"), ("quantity", "line.quantity", "int64", "span"))


def spans_with_attributes(spans: DataFrame) -> DataFrame:
    """Derived spans with the owner arrays of a stored table."""
    own = [ids.attribute_id(F.lit(k), F.col(c).cast("string"), F.lit(t), F.lit(s)) for c, k, t, s in _attribute_columns()]
    res = ids.attribute_id(F.lit("service.name"), F.col("service_name"), F.lit("string"), F.lit("resource"))
    return spans.withColumn("attribute_ids", ids.id_set(F.array(*own))).withColumn("resource_attribute_ids", F.array(res))


def attributes_of(spans: DataFrame) -> DataFrame:
    """Dictionary of what derived spans carry."""
    rows = [F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value"), F.lit(t).alias("type"), F.lit(s).alias("scope")) for c, k, t, s in _attribute_columns()]
    rows.append(F.struct(F.lit("service.name").alias("key"), F.col("service_name").alias("value"), F.lit("string").alias("type"), F.lit("resource").alias("scope")))
    flat = spans.select(F.explode(F.array(*rows)).alias("a")).select("a.*").distinct()
    return flat.select(ids.attribute_id(F.col("key"), F.col("value"), F.col("type"), F.col("scope")).alias("id"), "key", "value", "type", "scope")


def explicit_points(spark: SparkSession, sf_dir: str, name: str, odd_bounds: bool = False) -> DataFrame:
    """Explicit histogram datapoints of ``d_hist_delta`` or ``d_hist_cum``."""
    d = derived(spark, sf_dir, name)
    bounds = F.array(*map(F.lit, (10.0, 50.0, 100.0, 250.0)))
    if odd_bounds:
        bounds = F.when((F.col("user_id") % 50 == 0) & (F.col("day") % 2 == 1), F.array(*map(F.lit, (10.0, 50.0, 100.0, 500.0)))).otherwise(bounds)
    counts = F.array(*(F.col(c).cast("long") for c in ("c0", "c1", "c2", "c3", "c4")))
    return d.select("id", "stream_id", "series_id", "timestamp", "start_time", F.col("count").cast("long").alias("count"), "sum", bounds.alias("explicit_bounds"), counts.alias("bucket_counts"))


def exponential_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential histogram datapoints of ``d_exp_cells``: dense arrays from the least index."""
    c = derived(spark, sf_dir, "d_exp_cells")
    g = c.groupBy("event_type", "user_id", "day", "scale").agg(
        F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.sum(F.when(F.col("idx").isNull(), F.col("c")).otherwise(0)).alias("zero_count"), F.sum("c").alias("count"),
        F.map_from_entries(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "c")))).alias("cells"),
    )
    dense = F.transform(F.sequence("lo", "hi"), lambda i: F.coalesce(F.element_at("cells", i), F.lit(0).cast("long")))
    none = F.array().cast("array<bigint>")
    return g.select(
        F.concat_ws(":", "event_type", "user_id", "day").alias("id"), F.col("event_type").alias("stream_id"), F.concat_ws(":", "event_type", "user_id").alias("series_id"),
        (F.col("day") * 86_400_000_000_000).alias("timestamp"), ((F.col("day") - 1) * 86_400_000_000_000).alias("start_time"), F.col("count").cast("long").alias("count"), F.lit(None).cast("double").alias("sum"),
        F.col("scale").cast("int").alias("scale"), F.col("zero_count").cast("long").alias("zero_count"), F.lit(0.05).alias("zero_threshold"),
        F.coalesce("lo", F.lit(0)).cast("long").alias("positive_bucket_offset"), F.coalesce(dense, none).alias("positive_bucket_counts"), F.lit(0).cast("long").alias("negative_bucket_offset"), none.alias("negative_bucket_counts"),
    )


def cumulative_exponential_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential datapoints of ``d_sign_cells`` that count from the beginning of their series, at scale 2, of both signs."""
    from emberlake.functions import hist

    cells = derived(spark, sf_dir, "d_sign_cells")
    days = cells.select("series_id", "day").distinct()
    so_far = days.join(cells.withColumnRenamed("day", "of"), "series_id").filter("of <= day").groupBy("series_id", "day", "side", "idx").agg(F.sum("c").alias("c"))
    g = so_far.groupBy("series_id", "day").pivot("side", ["positive", "negative", "zero"]).agg(F.array_sort(F.collect_list(F.struct("idx", "c"))))
    count = F.aggregate(F.concat("positive", "negative", "zero"), F.lit(0).cast("long"), lambda n, x: n + x.c)
    sides = {f"{s}_bucket_{k}": v for s in ("positive", "negative") for k, v in (("offset", F.get(F.col(s), F.lit(0)).idx.cast("int")), ("counts", hist.dense(F.col(s))))}
    time = F.col("day") * 86_400_000_000_000
    zero = F.coalesce(F.get(F.col("zero"), F.lit(0)).c, F.lit(0))
    out = g.withColumns(sides | {"count": count, "zero_count": zero, "scale": F.lit(2), "zero_threshold": F.lit(0.05), "sum": F.lit(0.0), "timestamp": time, "start_time": time, "stream_id": F.lit("m")})
    return out.withColumn("id", F.concat("series_id", F.lit(":"), F.col("day").cast("string"))).drop("positive", "negative", "zero")
