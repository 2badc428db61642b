"""Trace list, span tree and salvage of malformed trees."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


DEEP = 8  # levels from which chains are measured against the size of their trace


def within(column: str | Column, start: int | None, end: int | None) -> Column:
    """Inclusive on both ends; an open end is None."""
    c = F.col(column) if isinstance(column, str) else column
    ok = F.lit(True)
    if start is not None:
        ok = ok & (c >= start)
    if end is not None:
        ok = ok & (c <= end)
    return ok


def search_traces(spans: DataFrame, start: int | None = None, end: int | None = None, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """One summary per trace, newest first, over the matching spans of the window.

    Counts are of matching spans only, so a filtered trace may show no root. Among several
    roots that of smallest span_id speaks. One partially aggregated shuffle by trace.
    """
    s = spans.filter(within("start_time", start, end))
    if where is not None:
        s = s.filter(where)
    root = F.col("parent_span_id").isNull()
    out = s.groupBy("trace_id").agg(
        F.min(F.when(root, F.struct("span_id", "service_name", "name"))).alias("root"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.count(F.lit(1)).alias("span_count"),
        F.count_if(F.col("status_code") == "Error").alias("error_count"),
    )
    out = out.select(
        "trace_id",
        F.col("root").isNotNull().alias("has_root_span"),
        F.when(F.col("root.service_name") != "", F.col("root.service_name")).alias("service_name"),
        F.col("root.name").alias("root_name"),
        "start_time",
        (F.col("end_time") - F.col("start_time")).alias("duration_ns"),
        "span_count",
        "error_count",
    )
    if limit is not None:
        out = out.orderBy(F.desc("start_time"), "trace_id").limit(limit)
    return out


def span_count(spans: DataFrame, trace_id: str) -> DataFrame:
    """Spans of a trace; 0 for an unknown one."""
    return spans.filter(F.col("trace_id") == trace_id).agg(F.count(F.lit(1)).alias("span_count"))


def ranked(spans: DataFrame) -> DataFrame:
    """Narrow rows with each span's place among its siblings (or among roots, parentless ones first)."""
    s = spans.select("trace_id", "span_id", "parent_span_id", "start_time")
    have = s.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("placed"))
    s = s.join(have, ["trace_id", "parent_span_id"], "left")
    s = s.withColumn("up", F.when(F.col("placed"), F.col("parent_span_id"))).drop("placed")
    among = Window.partitionBy("trace_id", "up").orderBy(F.when(F.col("up").isNull(), F.col("parent_span_id").isNotNull()), "start_time", "span_id")
    return s.withColumn("rank", F.row_number().over(among))


def span_tree(spans: DataFrame, most_levels: int = 1 << 20) -> DataFrame:
    """Depth and sort path of every span whose chain of parents ends at a root.

    A root has no parent, or one that is not in its trace. Paths are built by pointer
    jumping: each round joins every open span to its current ancestor, whose own partial
    path it takes over, so a tree of depth d needs about log2(d) joins, not d. Spans on or
    under a cycle never reach a root: after enough rounds for the longest possible chain
    they stay out (see `salvage`). Only open spans are carried on, those that are done are
    written once and looked up. Lineage is cut between rounds by checkpoint().
    """
    first = ranked(spans).select("trace_id", "span_id", F.col("up").alias("anc"), F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth"), F.array("rank").alias("path"))
    known = _cut(first)
    done, open_ = known.filter("anc is null"), known.filter("anc is not null")
    reach, size = 1, None
    while reach < most_levels and not open_.isEmpty():
        up = done.unionByName(open_).select("trace_id", F.col("span_id").alias("anc"), F.col("anc").alias("anc2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"))
        step = open_.join(up, ["trace_id", "anc"]).select("trace_id", "span_id", F.col("anc2").alias("anc"), (F.col("depth") + F.col("depth2")).alias("depth"), F.concat("path2", "path").alias("path"))
        if reach >= DEEP:  # a chain longer than its trace has spans goes round in a cycle
            size = _cut(spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("size"))) if size is None else size
            step = step.join(size, "trace_id").filter("anc is null or depth < size").drop("size")
        step = _cut(step)
        done, open_ = done.unionByName(step.filter("anc is null")), step.filter("anc is not null")
        reach *= 2
    return done.select("trace_id", "span_id", "depth", "path")


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; a local one only where all runs in this process."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.sc().isLocal():
            raise RuntimeError("executors share no local folder: name a shared one in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="emberlake-"))
    return df.checkpoint()


def salvage(spans: DataFrame, tree: DataFrame) -> DataFrame:
    """Depth and path of spans the tree left out (on cycles or under them).

    Every such span enters a walk that refuses to revisit; each keeps its earliest entry.
    Salvaged trees come after real roots. ``cycle_point`` marks a depth-0 one whose parent
    is salvaged too. Only unplaced spans take part, a rare remainder.
    """
    left = ranked(spans).join(tree.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_anti").select("trace_id", "span_id", "parent_span_id", "start_time", "rank")

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["start_time"], r["span_id"]))
        known = {r["span_id"]: r for r in rows}
        under: dict[str, list[dict]] = {}
        for r in sorted(rows, key=lambda r: r["rank"]):
            under.setdefault(r["parent_span_id"], []).append(r)
        placed: dict[str, dict] = {}
        for i, seed in enumerate(rows, 1):
            stack = [] if seed["span_id"] in placed else [(seed, 0, [1_000_000 + i])]
            while stack:
                r, depth, path = stack.pop()
                if r["span_id"] in placed:
                    continue
                placed[r["span_id"]] = {"trace_id": r["trace_id"], "span_id": r["span_id"], "depth": depth, "path": path, "cycle_point": depth == 0 and r["parent_span_id"] in known}
                stack += [(c, depth + 1, [*path, c["rank"]]) for c in reversed(under.get(r["span_id"], []))]
        return pa.Table.from_pylist(list(placed.values()), schema=pa.schema([("trace_id", pa.string()), ("span_id", pa.string()), ("depth", pa.int32()), ("path", pa.list_(pa.int32())), ("cycle_point", pa.bool_())]))

    return left.groupBy("trace_id").applyInArrow(run, "trace_id string, span_id string, depth int, path array<int>, cycle_point boolean")


def search_spans(spans: DataFrame, where: Column | None = None) -> DataFrame:
    """Whole traces in tree order with ``matched`` flags, salvaged spans last; offsets count from the trace's earliest start."""
    tree = span_tree(spans)
    placed = tree.withColumn("salvaged", F.lit(False)).withColumn("cycle_point", F.lit(False))
    total = spans.count()
    if tree.count() < total:  # the rare walk runs only where something is unplaced
        placed = placed.unionByName(salvage(spans, tree).withColumn("salvaged", F.lit(True)))
    matched = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    s = spans.withColumn("matched", matched).join(placed, ["trace_id", "span_id"])
    first = spans.groupBy("trace_id").agg(F.min("start_time").alias("trace_start"))
    order = Window.partitionBy("trace_id").orderBy("path", "span_id")
    s = s.join(first, "trace_id").withColumn("position", F.row_number().over(order))
    return s.withColumn("offset_ns", F.col("start_time") - F.col("trace_start")).withColumn("duration_ns", F.col("end_time") - F.col("start_time"))


def unplaced_count(spans: DataFrame) -> DataFrame:
    """Spans of each trace that no root reaches."""
    tree = span_tree(spans)
    return spans.join(tree, ["trace_id", "span_id"], "left_anti").groupBy("trace_id").agg(F.count(F.lit(1)).alias("unplaced"))


def error_spans(spans: DataFrame, events: DataFrame) -> DataFrame:
    """Spans with status Error or an event named ``exception``."""
    bad = events.filter("name = 'exception'").select("span_id").distinct().withColumn("threw", F.lit(True))
    s = spans.join(bad, "span_id", "left")
    return s.filter((F.col("status_code") == "Error") | F.coalesce("threw", F.lit(False))).drop("threw")


def parent_of(tree: DataFrame) -> DataFrame:
    """Structural parent of each placed span, from its path."""
    up = tree.select("trace_id", F.col("span_id").alias("structural_parent"), F.col("path").alias("parent_path"))
    return tree.withColumn("parent_path", F.slice("path", 1, F.size("path") - 1)).join(up, ["trace_id", "parent_path"], "left").drop("parent_path")
