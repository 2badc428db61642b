"""The metric pipeline: reduction to chart resolution, views, pools, sparklines, merges.

Points are rows (id, stream_id, series_id, timestamp, ...). Scalars carry ``value``;
histograms carry count arrays. Every stage is a function from DataFrame to DataFrame, and
all work on many streams at once where the stage does not fix a shared grid. Orders end
in unique keys, so answers depend on data alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions import buckets, hist
from emberlake.operators.traces import within

EXEMPLARS, CARRIERS = 5, 2


def by_time():
    return Window.partitionBy("series_id").orderBy("timestamp", "id")


@dataclass(frozen=True)
class Request:
    """What a caller asks of one metric. None and empty lists differ as noted."""

    start: int | None = None
    end: int | None = None
    target_buckets: int = 0
    series_ids: list[str] | None = None  # None: all, []: none
    quantiles: list[float] = field(default_factory=list)
    tz_offset_ns: int = 0
    fit_to_data: bool = False
    view_buckets: int = 0
    sparkline_buckets: int = 0
    selected_series_ids: list[str] | None = None  # None or []: nothing selected
    datapoint_series_ids: list[str] | None = None  # None: by limit, []: ship none
    datapoint_series_limit: int | None = None
    tz_name: str | None = None


def window(points: DataFrame, r: Request) -> DataFrame:
    """Points of the window and of the named series."""
    p = points.filter(within("timestamp", r.start, r.end))
    return p if r.series_ids is None else p.filter(F.col("series_id").isin(r.series_ids))


def span_ns(points: DataFrame, r: Request) -> int | None:
    """Length that the ladder is asked about: of the data, or of the window."""
    if not r.fit_to_data and r.start is not None and r.end is not None:
        return r.end - r.start
    got = points.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    return None if got.a is None else got.b - got.a + 1


def reduction_kind(metric_type: str, temporality: str, width: int | None) -> str:
    """none, elect (Gauge, Sum) or merge (histograms whose temporality is known)."""
    histogram = metric_type in ("Histogram", "ExponentialHistogram")
    if width is None or histogram and temporality not in ("Delta", "Cumulative"):
        return "none"
    return "merge" if histogram else "elect"


def bucketed(points: DataFrame, width: int, r: Request = Request()) -> DataFrame:
    """Adds ``bucket_start``. A target of one bucket is a summary: it starts where the data does."""
    if r.target_buckets == 1:
        first = points.agg(F.min("timestamp")).first()[0]
        return points.withColumn("bucket_start", F.lit(first).cast("long"))
    return points.withColumn("bucket_start", buckets.bucket_start(F.col("timestamp"), width, r.tz_name, r.tz_offset_ns))


# ---- scalars -----------------------------------------------------------------------


def finite_scalars(points: DataFrame) -> DataFrame:
    return points.filter(hist.finite(F.col("value")))


def deltas(points: DataFrame) -> DataFrame:
    """Activity since the previous reading of the series; a fall is a restart and counts whole. First readings have none."""
    prev = F.lag("value").over(by_time())
    p = finite_scalars(points).withColumn("prev", prev)
    fell = F.col("value") < F.col("prev")
    return p.withColumn("delta", F.when(fell, F.col("value")).otherwise(F.col("value") - F.col("prev"))).withColumn("is_reset", fell).drop("prev")


def cadence(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median over series of each series' median positive gap, in all or for each of ``by``."""
    gaps = points.withColumn("gap", F.col("timestamp") - F.lag("timestamp").over(by_time())).filter("gap > 0")
    per = gaps.groupBy(*by, "series_id").agg(F.median("gap").alias("gap"))
    return per.groupBy(*by).agg(F.median("gap").alias("cadence_ns"))


def grid_width(points: DataFrame, r: Request, wanted: int) -> int | None:
    """Width of a view grid: never more buckets than the stream has reporting intervals."""
    span = span_ns(points, r)
    c = cadence(finite_scalars(points)).first()
    if span is not None and c is not None and c.cadence_ns and c.cadence_ns > 0:
        wanted = min(wanted, max(1, int(span // c.cadence_ns)))
    return buckets.width_of(span, wanted)


def elected(points: DataFrame) -> DataFrame:
    """First, last, least and greatest reading of each series and bucket (extremes among finite ones)."""
    by_value = F.when(hist.finite(F.col("value")), F.struct("value", "id"))
    return points.groupBy("series_id", "bucket_start").agg(
        F.min(F.struct("timestamp", "id"))["id"].alias("first_id"),
        F.max(F.struct("timestamp", "id"))["id"].alias("last_id"),
        F.min(by_value)["id"].alias("min_id"),
        F.max(by_value)["id"].alias("max_id"),
    )


def retained(points: DataFrame, exemplars: DataFrame | None = None) -> DataFrame:
    """Ids that an election keeps, with each bucket's few exemplar carriers."""
    four = elected(points).select(F.explode(F.array("first_id", "last_id", "min_id", "max_id")).alias("id")).filter("id is not null").distinct()
    if exemplars is None:
        return four
    return four.union(carriers(points, exemplars).select("id")).distinct()


def views(points: DataFrame, width: int, r: Request = Request()) -> DataFrame:
    """A row for each series and bucket between the series' first and last one, empty ones too.

    Columns: sample_count, value_sum, value_avg, rate (delta per second) and has_reset.
    The spine steps in local time, so a day stays a day over a clock change.
    """
    p = deltas(points)
    local = buckets.floor_to(buckets.to_local(F.col("timestamp"), r.tz_name, r.tz_offset_ns), width)
    p = p.withColumn("local", local).withColumn("bucket_start", buckets.to_utc(F.col("local"), r.tz_name, r.tz_offset_ns))
    ends = p.groupBy("series_id").agg(F.min("local").alias("a"), F.max("local").alias("b"))
    spine = ends.withColumn("local", F.explode(F.sequence("a", "b", F.lit(width).cast("long"))))
    spine = spine.select("series_id", buckets.to_utc(F.col("local"), r.tz_name, r.tz_offset_ns).alias("bucket_start")).distinct()
    filled = p.groupBy("series_id", "bucket_start").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum"), F.avg("value").alias("value_avg"), (F.sum("delta") / (width / 1e9)).alias("rate"), F.bool_or("is_reset").alias("reset")
    )
    out = spine.join(filled, ["series_id", "bucket_start"], "left")
    return out.select("series_id", "bucket_start", F.coalesce("n", F.lit(0)).alias("sample_count"), "value_sum", "value_avg", "rate", F.coalesce("reset", F.lit(False)).alias("has_reset"))


def drawn(view: DataFrame) -> DataFrame:
    """The rate line as charted: empty buckets draw zero, a bucket with samples but no rate draws nothing."""
    d = view.withColumn("drawn_rate", F.when(F.col("sample_count") == 0, F.lit(0.0)).otherwise(F.col("rate")))
    return d.filter("drawn_rate is not null")


def slopes(view: DataFrame, by: str = "series_id") -> DataFrame:
    """Change of the drawn rate per second on the segment that arrives at each point."""
    w = Window.partitionBy(by).orderBy("bucket_start")
    rise = F.col("drawn_rate") - F.lag("drawn_rate").over(w)
    run = (F.col("bucket_start") - F.lag("bucket_start").over(w)) / 1e9
    return drawn(view).select(by, "bucket_start", "drawn_rate", (rise / run).alias("slope"))


def rate_stats(view: DataFrame, by: str = "series_id") -> DataFrame:
    return drawn(view).groupBy(by).agg(F.min("drawn_rate").alias("min_rate"), F.max("drawn_rate").alias("max_rate"), F.avg("drawn_rate").alias("avg_rate"))


def pools(view: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """Cross-series lines: ``all`` series and the ``selected`` ones. Pooled mean is of samples, not of means."""
    rows = view.withColumn("pool", F.lit("all"))
    if selected:
        rows = rows.unionByName(view.filter(F.col("series_id").isin(selected)).withColumn("pool", F.lit("selected")))
    total = rows.groupBy("pool", "bucket_start").agg(
        F.sum("sample_count").alias("sample_count"), F.sum("value_sum").alias("value_sum"), F.sum("rate").alias("rate"), F.bool_or("has_reset").alias("has_reset")
    )
    return total.withColumn("value_avg", F.try_divide("value_sum", "sample_count"))


def sparkline(points: DataFrame, width: int | None, r: Request = Request()) -> DataFrame:
    """Least and greatest value of each bucket at their own times; no grid, no points."""
    p = finite_scalars(points)
    if width is None:
        return p.select("series_id", "timestamp", "value").limit(0)
    p = p.withColumn("bucket_start", buckets.bucket_start(F.col("timestamp"), width, r.tz_name, r.tz_offset_ns))
    at = F.struct("value", "timestamp")
    two = p.groupBy("series_id", "bucket_start").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    return two.select("series_id", F.explode(F.array("lo", "hi")).alias("p")).select("series_id", "p.timestamp", "p.value").distinct()


# ---- exemplars ---------------------------------------------------------------------


def ranked_exemplars(exemplars: DataFrame, most: int = EXEMPLARS) -> DataFrame:
    """At most ``most`` exemplars of a datapoint, taken from both ends of their values (not finite ones last), with the true count."""
    ok = F.when(hist.finite(F.col("value")), F.col("value"))
    e = exemplars.withColumn("v", ok)
    up = F.row_number().over(Window.partitionBy("datapoint_id").orderBy(F.asc_nulls_last("v"), "id"))
    down = F.row_number().over(Window.partitionBy("datapoint_id").orderBy(F.desc_nulls_last("v"), "id"))
    e = e.withColumn("end", F.least(up, down)).withColumn("exemplar_count", F.count(F.lit(1)).over(Window.partitionBy("datapoint_id")))
    e = e.withColumn("rank", F.row_number().over(Window.partitionBy("datapoint_id").orderBy("end", "id")))
    return e.filter(F.col("rank") <= most).drop("v", "end")


def exemplar_extents(exemplars: DataFrame) -> DataFrame:
    ok = F.when(hist.finite(F.col("value")), F.col("value"))
    return exemplars.groupBy("datapoint_id").agg(F.min(ok).alias("low"), F.max(ok).alias("high"), F.count(F.lit(1)).alias("exemplar_count"))


def carriers(points: DataFrame, exemplars: DataFrame, most: int = CARRIERS) -> DataFrame:
    """The exemplar-bearing points a bucket keeps: those that reach lowest and highest."""
    b = points.select("id", "series_id", "bucket_start").join(exemplar_extents(exemplars).withColumnRenamed("datapoint_id", "id"), "id")
    key = ("series_id", "bucket_start")
    up = F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("low"), "id"))
    down = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last("high"), "id"))
    b = b.withColumn("end", F.least(up, down)).withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("end", "id")))
    return b.filter(F.col("rank") <= most).select("id", *key)


# ---- histograms --------------------------------------------------------------------


def _aligned(points: DataFrame) -> DataFrame:
    """Exponential points of each series at one scale and one offset."""
    w = Window.partitionBy("series_id")
    p = points.withColumn("target_scale", F.min("scale").over(w))
    levels = F.col("scale") - F.col("target_scale")
    for side in ("positive", "negative"):
        p = p.withColumn(f"{side}_d", hist.downscale(F.col(f"{side}_bucket_counts"), F.col(f"{side}_bucket_offset"), levels))
        # empty arrays have no say in where counts begin
        target = F.min(F.when(F.size(f"{side}_d.counts") > 0, F.col(f"{side}_d.offset"))).over(w)
        p = p.withColumn(f"{side}_target", target)
        p = p.withColumn(f"{side}_p", hist.pad_left(F.col(f"{side}_d.counts"), F.col(f"{side}_d.offset"), F.coalesce(F.col(f"{side}_target"), F.col(f"{side}_d.offset"))))
    return p.drop("positive_d", "negative_d")


def _merged_cells(points: DataFrame, head: DataFrame, by: Sequence[str]) -> DataFrame:
    """Dense count arrays of both sides at the scale of ``head``.

    Cells are summed at their own scale first, then at the group's: both sums are partially
    aggregated, so a group of very many points costs no task more than its distinct cells.
    """
    sides = F.array(*(F.struct(F.lit(x).alias("side"), F.col(f"{x}_bucket_offset").cast("long").alias("offset"), F.col(f"{x}_bucket_counts").alias("counts")) for x in ("positive", "negative")))
    each = points.select(*by, "scale", F.explode(sides).alias("s")).select(*by, "scale", "s.side", "s.offset", F.posexplode("s.counts").alias("pos", "c"))
    own = each.groupBy(*by, "side", "scale", (F.col("offset") + F.col("pos")).alias("idx")).agg(F.sum("c").alias("c"))
    target = head.select(*by, F.col("scale").alias("target_scale"))
    cells = own.join(target, list(by)).groupBy(*by, "side", hist.downscaled_offset(F.col("idx"), F.col("scale") - F.col("target_scale")).alias("idx")).agg(F.sum("c").alias("c"))
    arrays = cells.groupBy(*by).pivot("side", ["positive", "negative"]).agg(F.array_sort(F.collect_list(F.struct("idx", "c"))))
    for side in ("positive", "negative"):
        arrays = arrays.withColumn(f"{side}_bucket_offset", F.get(F.col(side), F.lit(0)).idx).withColumn(f"{side}_bucket_counts", hist.dense(F.col(side))).drop(side)
    return arrays


def _activity(points: DataFrame, vectors: Sequence[str], scalars: Sequence[str]) -> DataFrame:
    """Cumulative readings as the activity of their interval. Scalars restart where the count falls, a vector where any element does."""
    p = points
    for c in (*scalars, *vectors):
        p = p.withColumn(f"prev_{c}", F.lag(c).over(by_time()))
    p = p.filter("prev_count is not null")
    fell = F.col("count") < F.col("prev_count")
    p = p.withColumns({c: F.when(fell, F.col(c)).otherwise(F.col(c) - F.col(f"prev_{c}")) for c in scalars} | {v: F.coalesce(hist.subtract_vectors(F.col(v), F.col(f"prev_{v}")), F.col(v)) for v in vectors})
    return p.drop(*(f"prev_{c}" for c in (*scalars, *vectors)))


def merge_explicit(points: DataFrame, cumulative: bool = False, by: Sequence[str] = ("series_id", "bucket_start")) -> DataFrame:
    """One histogram for each group. ``distinct_bounds`` above 1 marks a group that cannot be merged.

    Counts add element by element as position-wise sums, so partial aggregation applies.
    """
    p = _activity(points, ("bucket_counts",), ("count", "sum")) if cumulative else points
    head = p.groupBy(*by).agg(
        F.max(F.struct("timestamp", "id"))["id"].alias("id"), F.min("start_time").alias("start_time"), F.sum("count").alias("count"), F.sum("sum").alias("sum"),
        F.min("explicit_bounds").alias("explicit_bounds"), F.count_distinct("explicit_bounds").alias("distinct_bounds"),
    )
    cells = p.select(*by, F.posexplode("bucket_counts").alias("pos", "c")).groupBy(*by, "pos").agg(F.sum("c").alias("c"))
    arrays = cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x.c).alias("bucket_counts"))
    return head.join(arrays, list(by), "left")


def merge_exponential(points: DataFrame, cumulative: bool = False, by: Sequence[str] = ("series_id", "bucket_start")) -> DataFrame:
    """Exact merge of exponential histograms: coarsest scale, common offset, sums, then the zero threshold settles what is zero."""
    p = points
    if cumulative:  # readings are differenced along their series, at one scale and offset
        p = _activity(_aligned(points), ("positive_p", "negative_p"), ("count", "sum", "zero_count"))
        p = p.withColumns({"scale": F.col("target_scale")} | {f"{x}_bucket_{y}": F.col(f"{x}_{z}") for x in ("positive", "negative") for y, z in (("counts", "p"), ("offset", "target"))})
    head = p.groupBy(*by).agg(
        F.max(F.struct("timestamp", "id"))["id"].alias("id"), F.min("start_time").alias("start_time"), F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("scale").alias("scale"),
        F.max("zero_threshold").alias("zero_threshold"), F.sum("zero_count").alias("zero_count"),
    )
    m = head.join(_merged_cells(p, head, by), list(by), "left")
    m = m.withColumns({f"{x}_bucket_offset": F.coalesce(f"{x}_bucket_offset", F.lit(0).cast("long")) for x in ("positive", "negative")})
    sides = [hist.zero_fold(F.col(f"{x}_bucket_counts"), F.col(f"{x}_bucket_offset"), F.col("zero_threshold"), F.col("scale")).alias(x) for x in ("positive", "negative")]
    m = m.select("*", once(F.struct(*sides)).alias("sides"))
    changed = {f"{x}_bucket_{y}": F.col(f"sides.{x}.{y}") for x in ("positive", "negative") for y in ("counts", "offset")}
    return m.withColumns(changed | {"zero_count": F.col("zero_count") + F.col("sides.positive.folded") + F.col("sides.negative.folded")}).drop("sides")


def once(value: Column) -> Column:
    """A generator of the one value: projections above it are not merged with those below, where each use would make the value again."""
    return F.explode(F.array(value))


def with_extents(merged: DataFrame, exponential: bool) -> DataFrame:
    """Adds min and max as the merged buckets tell them."""
    b = _buckets(exponential)
    return merged.select("*", once(hist.extents(b)).alias("e")).withColumn("min", F.col("e.min")).withColumn("max", F.col("e.max")).drop("e")


def _buckets(exponential: bool) -> Column:
    if exponential:
        return hist.exponential_buckets(*(F.col(c) for c in ("scale", "negative_bucket_offset", "negative_bucket_counts", "zero_count", "positive_bucket_offset", "positive_bucket_counts")))
    return hist.explicit_buckets(F.col("explicit_bounds"), F.col("bucket_counts"))


def with_quantiles(merged: DataFrame, qs: Sequence[float], exponential: bool) -> DataFrame:
    """Adds a map from q to value."""
    if not qs:
        return merged.withColumn("quantiles", hist.quantiles(None, ()))
    return merged.select("*", once(hist.all_quantiles(_buckets(exponential), qs, hist.log_linear if exponential else hist.linear)).alias("quantiles"))


def quantile_lines(with_q: DataFrame) -> DataFrame:
    """A row for each point and quantile, for per-series lines."""
    return with_q.select("series_id", "bucket_start", F.explode("quantiles").alias("q", "value"))


def bounds_mismatch(merged: DataFrame) -> DataFrame:
    """Rows and buckets refused because boundary sets differ."""
    return merged.filter("distinct_bounds > 1").agg(F.count(F.lit(1)).alias("refused_rows"), F.count_distinct("bucket_start").alias("refused_buckets"))


def cross_series_explicit(merged: DataFrame) -> DataFrame:
    """One histogram for each bucket over all series; buckets with a refused row, or whose series differ in bounds, stay out."""
    refused = merged.filter("distinct_bounds > 1").select("bucket_start").distinct()
    p = merged.join(refused, "bucket_start", "left_anti").withColumn("timestamp", F.col("bucket_start"))
    out = merge_explicit(p.drop("distinct_bounds"), by=("bucket_start",))
    return out.filter("distinct_bounds <= 1")


def cross_series_exponential(merged: DataFrame) -> DataFrame:
    p = merged.withColumn("timestamp", F.col("bucket_start"))
    return merge_exponential(p, by=("bucket_start",))


# ---- series and streams ------------------------------------------------------------


def series_rank(points: DataFrame) -> DataFrame:
    """Series by latest point, newest first, with counts over the window."""
    per = points.groupBy("series_id").agg(F.max("timestamp").alias("latest"), F.count(F.lit(1)).alias("datapoint_count"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("latest"), "series_id")))


def shipped_series(points: DataFrame, r: Request) -> DataFrame:
    """Series whose points are shipped: the named ones, else the first so many, else all."""
    ranks = series_rank(points)
    if r.datapoint_series_ids is not None:
        return ranks.filter(F.col("series_id").isin(r.datapoint_series_ids))
    return ranks if r.datapoint_series_limit is None else ranks.filter(F.col("rank") <= r.datapoint_series_limit)


def series_stats(points: DataFrame) -> DataFrame:
    """Count, extremes, mean and latest value over every projected reading (NaN included, as it sorts highest)."""
    return points.groupBy("series_id").agg(
        F.count("value").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("avg_value"), F.sum("value").alias("sum_value"), F.max(F.struct("timestamp", "id", "value"))["value"].alias("last_value")
    )


def get_metric(points: DataFrame, metric_type: str, temporality: str = "", r: Request = Request(), exemplars: DataFrame | None = None) -> dict[str, DataFrame]:
    """All answers about one stream's points as DataFrames: datapoints, series, views, pools, sparklines, aggregate."""
    p = window(points, r)
    width = buckets.width_of(span_ns(p, r), r.target_buckets)
    kind = reduction_kind(metric_type, temporality, width)
    out: dict[str, DataFrame] = {"window_counts": series_rank(p)}
    if metric_type in ("Gauge", "Sum"):
        rows = p if metric_type == "Gauge" or temporality != "Cumulative" else p.join(deltas(p).select("id", "delta", "is_reset"), "id", "left")
        if kind == "elect":
            rows = rows.join(retained(bucketed(p, width, r), exemplars), "id", "left_semi")
        view = grid_width(p, r, r.view_buckets)
        if view is not None:
            out["views"] = views(p, view, r)
            out["slopes"], out["rate_stats"] = slopes(out["views"]), rate_stats(out["views"])
            out["pools"] = pools(out["views"], r.selected_series_ids)
            out["pool_slopes"], out["pool_rate_stats"] = slopes(out["pools"], "pool"), rate_stats(out["pools"], "pool")
        out["sparkline"] = sparkline(p, grid_width(p, r, r.sparkline_buckets), r)
        out["series"] = series_stats(p)
    else:
        exponential = metric_type == "ExponentialHistogram"
        rows = p
        if kind == "merge":
            b = bucketed(p, width, r)
            merged = (merge_exponential if exponential else merge_explicit)(b, temporality == "Cumulative")
            if not exponential:
                out["bounds_mismatch"] = bounds_mismatch(merged)
                rows = merged.filter("distinct_bounds <= 1")
            across = (cross_series_exponential if exponential else cross_series_explicit)(merged)
            across = across.withColumn("timestamp", F.col("bucket_start"))
            out["aggregate"] = with_quantiles(with_extents(across, exponential), r.quantiles, exponential)
            rows = with_extents(merged if exponential else rows, exponential).withColumn("timestamp", F.col("bucket_start"))
        out["datapoints"] = with_quantiles(rows, r.quantiles, exponential)
    out["datapoints"] = out.get("datapoints", rows).join(shipped_series(p, r).select("series_id"), "series_id", "left_semi")
    if exemplars is not None:
        out["exemplars"] = ranked_exemplars(exemplars.join(out["datapoints"].select(F.col("id").alias("datapoint_id")), "datapoint_id", "left_semi"))
    return out


def representative_ingest(ingests: DataFrame, points: DataFrame) -> DataFrame:
    """Of each stream, the ingest whose points are the most recent (then the larger id)."""
    latest = points.groupBy("metric_ingest_id").agg(F.max("timestamp").alias("latest"))
    i = ingests.join(latest, ingests.id == latest.metric_ingest_id)
    return i.groupBy("stream_id").agg(F.max(F.struct("latest", "id", "description")).alias("r")).select("stream_id", F.col("r.id").alias("ingest_id"), F.col("r.description").alias("description"))


def search_summaries(streams: DataFrame, points: DataFrame, series: DataFrame, ingests: DataFrame | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """A card for each stream that has a point in the window; cardinality is over all time. One pass over the points."""
    p = points.filter(within("timestamp", start, end))
    per = p.groupBy("stream_id").agg(
        F.count_distinct("series_id").alias("series_count"), F.count(F.lit(1)).alias("datapoint_count"), F.max(F.struct("timestamp", "id", "value")).alias("last"), F.max("timestamp").alias("last_seen")
    )
    life = series.groupBy("stream_id").agg(F.count(F.lit(1)).alias("series_cardinality"))
    scalar = F.col("metric_type").isin("Gauge", "Sum")
    out = streams.withColumnRenamed("id", "stream_id").join(per, "stream_id").join(life, "stream_id", "left")
    if ingests is not None:
        out = out.join(representative_ingest(ingests, p).drop("ingest_id"), "stream_id", "left")
    return out.withColumn("last_value", F.when(scalar, F.col("last.value"))).withColumn("series_cardinality", F.coalesce("series_cardinality", F.lit(0))).drop("last")


# ---- readings of a chart -----------------------------------------------------------


def resampled(points: DataFrame, width: int) -> DataFrame:
    """Last point of each half-open bucket, drawn at the bucket's centre."""
    b = buckets.floor_to(F.col("timestamp"), width)
    return points.groupBy("series_id", b.alias("b")).agg(F.max(F.struct("timestamp", "id", "value"))["value"].alias("value")).select("series_id", (F.col("b") + width // 2).alias("centre"), "value")


def heat_thresholds(most: int, steps: int) -> list[int]:
    """Upper counts of colour steps between 1 and the largest cell."""
    return [] if most <= 0 else [-(-most * i // steps) for i in range(1, steps + 1)]


def distinguishing(labels: DataFrame) -> DataFrame:
    """Keys of (series_id, key, value) whose value differs between series, or that some lack."""
    n = labels.agg(F.count_distinct("series_id")).first()[0]
    per = labels.groupBy("key").agg(F.count_distinct("value").alias("values"), F.count_distinct("series_id").alias("series"))
    return per.filter((F.col("values") > 1) | (F.col("series") < n))


# Views a chart offers for a kind of metric: (available, default).
VIEWS: dict[tuple[str, bool], tuple[tuple[str, ...], str]] = {
    ("Gauge", False): (("value", "average"), "value"),
    ("Sum", False): (("value", "sum", "average"), "value"),
    ("Sum", True): (("value", "sum", "average", "rate"), "rate"),
    ("Histogram", False): (("heatmap", "quantiles"), "heatmap"),
    ("ExponentialHistogram", False): (("heatmap", "quantiles"), "heatmap"),
}


def stat_badges(metric_type: str, temporality: str, view: str) -> tuple[str, ...]:
    """Statistics worth showing beside a series: a mean rate says little, and a total only makes sense for raw deltas."""
    total = metric_type == "Sum" and temporality == "Delta" and view == "raw"
    return ("min", "max", *(() if view == "rate" else ("avg",)), *(("total",) if total else ()))


def slope_offered(metric_type: str, temporality: str, monotonic: bool | None, view: str) -> bool:
    """Whether a chart can say how fast its rate changes: only the rate of a counter that runs on."""
    return metric_type == "Sum" and temporality == "Cumulative" and monotonic is True and view == "rate"
