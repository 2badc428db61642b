"""Connected components over distributed edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.kernels import lean
from emberlake.llm.scratch import Scratch

ONE_TASK = 1 << 18  # edges that one task may hold: some tens of megabytes


def forest(edges: list[tuple]) -> dict:
    """Node to the smallest node of its component."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch as stars around its smallest nodes: never more rows than came in."""
    for batch in batches:
        stars = forest(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
        pairs = [(x, r) for x, r in stars.items() if x != r]
        kind = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)], ["u", "v"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges that come."""
    edges, kind = [], None
    for batch in batches:
        kind = batch.schema.field(0).type
        edges += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
    rows = list(forest(edges).items())
    for at in range(0, len(rows), 8192):
        nodes, roots = zip(*rows[at : at + 8192], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(roots, kind)], ["node", "root"])


def _is_star_forest(edges: DataFrame) -> bool:
    """No node is both a leaf and a centre, and no leaf has two centres."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return seen.filter("leaf > 1 or (leaf > 0 and centre > 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns): root is its component's smallest node.

    Edges are first contracted to stars within each batch, then alternating large-star and
    small-star steps run until only stars are left (about the square of a logarithm of steps). Each step is a partially aggregated minimum
    joined back to its edges, so a node of very many edges is split like any skewed join.
    What is left of at most ONE_TASK edges after the contraction is settled in one task.
    """
    a, b = edges.columns
    kind = edges.schema[0].dataType.simpleString()
    now = scratch.keep(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").mapInArrow(_contract, f"u {kind}, v {kind}"), "edges", few=True)
    if now.count() <= ONE_TASK:
        out = scratch.keep(now.repartition(1).mapInArrow(lean(_settled), f"node {kind}, root {kind}"), "components")
        scratch.drop(now)
        return out
    while not _is_star_forest(now):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(low2, "u")
        small = step.select("u", F.col("m").alias("v")).union(step.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = scratch.keep(small, "star")
        scratch.drop(now)
        now = after
    return scratch.keep(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct(), "components")
