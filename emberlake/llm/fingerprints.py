"""Document fingerprints from closed syncmers.

A k-gram of bytes is a closed syncmer if the least of its inner s-grams lies at either
edge. That depends on the k-gram alone, so the same passage gives the same anchors in
any context. Each occurrence is an anchor: equal k-grams of a text are told apart by their
number, so that repeated passages weigh by their length. A fingerprint keeps the anchors of
least hash, in order of place: at least ANCHORS, and one of SPARSE in long texts, so that
its density stays the same however long the text. Two fingerprints are matched by position:
shared anchors that keep their order count, as a share of the least hashes of both together.
With ``sparse=1`` all anchors are kept and the likeness is exact.

Defined results: null and empty texts have the empty fingerprint; two empty fingerprints
are alike (1), an empty and another one are not (0); texts too short for a k-gram have
one anchor of all their bytes; equal texts have equal fingerprints; rows are ordered by
doc_id descending (null last), ties by text; extra columns are ignored; an empty table
gives an empty result, and a table of one row is its own next.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.kernels import BYTE_VALUE, U64, lean, mix, powers, small_batches
from emberlake.llm.scratch import shuffle_partitions

K, S = 16, 6
ANCHORS = 64  # anchors of a fingerprint, at least
SPARSE = 16  # one of so many anchors is kept where that is more
MOST_RANGES = 4096  # a column expression holds the borders of the ranges


def _rolling(buf: np.ndarray, size: int, acc: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    n = len(buf) - size + 1
    return mix((acc[size : size + n] - acc[:n]) * inverse[:n])


def syncmers(raw: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of all closed syncmers of a byte string."""
    buf = np.frombuffer(raw, np.uint8)
    n = len(buf)
    if n < k:
        if not n:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        return np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), U64), np.zeros(1, np.int64)
    p, q = powers(n + 1)
    acc = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUE[buf] * p[:n], out=acc[1:])
    small = _rolling(buf, s, acc, q)
    span, step, low = k - s + 1, 1, small
    while 2 * step <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if span > step:
        low = np.minimum(low[: -(span - step)], low[span - step :])
    m = n - k + 1
    at = np.flatnonzero((small[:m] == low) | (small[k - s : k - s + m] == low))
    return mix((acc[at + k] - acc[at]) * q[at] + U64(k)), at


@dataclass(frozen=True)
class Fingerprint:
    """Anchors (hash, place) in order of place; ``limit`` is the largest hash kept, or None where all are."""

    anchors: tuple[tuple[int, int], ...]
    limit: int | None = None


def fingerprint(raw: bytes, sparse: int = SPARSE, least: int = ANCHORS) -> Fingerprint:
    h, at = syncmers(raw)
    if not len(h):
        return Fingerprint(())
    order = np.argsort(h, kind="stable")
    u = h[order]
    new = np.ones(len(u), bool)
    new[1:] = u[1:] != u[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(u)), 0))
    number = (np.arange(len(u)) - lead).astype(U64)
    key = np.where(number == 0, u, mix(u + number * U64(0x9E3779B97F4A7C15))) >> U64(32)
    keep = max(least, -(-len(h) // sparse))
    if keep >= len(h):
        chosen, limit = np.arange(len(h)), None
    else:
        chosen = np.argsort(key, kind="stable")[:keep]
        limit = int(key[chosen[-1]])
    place = at[order[chosen]]
    by = np.argsort(place, kind="stable")
    return Fingerprint(tuple(zip(key[chosen][by].tolist(), place[by].tolist(), strict=True)), limit)


def written(fp: Fingerprint) -> str:
    """Text form: the limit, if any, after a tilde, then 8 hex digits of hash and the place of each anchor, by place."""
    return " ".join([*([] if fp.limit is None else [f"~{fp.limit:08x}"]), *(f"{h:08x}@{p:x}" for h, p in fp.anchors)])


def read(text: str) -> Fingerprint:
    words = text.split()
    limit = int(words.pop(0)[1:], 16) if words and words[0][0] == "~" else None
    return Fingerprint(tuple((int(x[:8], 16), int(x[9:], 16)) for x in words), limit)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Shared anchors in equal order, as a share of the least hashes of both together."""
    if not a.anchors or not b.anchors:
        return float(not a.anchors and not b.anchors)
    # hashes up to here were kept by both sides, had they been there
    limit = min((x.limit for x in (a, b) if x.limit is not None), default=1 << 32)
    x, y = ({h: p for h, p in f.anchors if h <= limit} for f in (a, b))
    shared = sorted((p, y[h]) for h, p in x.items() if h in y)
    tails: list[int] = []
    for _, place in shared:
        i = bisect_left(tails, place)
        tails[i : i + 1] = [place]
    return len(tails) / len(x.keys() | y.keys())


def edited(text: str, follower: str) -> str:
    """The last third of ``text`` replaced by as much of the beginning of ``follower``."""
    n = len(text) // 3
    return text[: len(text) - n] + follower[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _follow(sparse: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; each is compared with the next one. A guest row is only a neighbour."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held: tuple | None = None
    out: list[tuple] = []
    part = None
    for batch in batches:
        for doc_id, text, bucket, guest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            own = fingerprint((text or "").encode("utf-8", "surrogatepass"), sparse)
            if held is not None and part == bucket and not held[3]:
                body = edited(held[1], text or "").encode("utf-8", "surrogatepass")
                changed = fingerprint(body, sparse)
                out.append((held[0], len(held[1]), hashlib.sha256(body).hexdigest(), written(held[2]), written(changed), likeness(held[2], changed), likeness(held[2], own)))
            held, part = (doc_id, text or "", own, guest), bucket
            if len(out) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def with_next(docs: DataFrame, sparse: int = SPARSE) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likenesses.

    Rows are cut into ranges of doc_id; the first row of each range also goes, as a guest,
    to the end of the range before it (the very first to the last), so that neighbours
    meet with one shuffle of the texts. One number a range comes to the driver. ``sparse``
    of 1 keeps every anchor.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", key)
    cuts = _cuts(d, parts)
    bucket = _rank(F.col("key"), cuts, 0, len(cuts))
    tops = sorted(d.select(bucket.alias("b"), "key").groupBy("b").agg(F.max("key").alias("top")).collect(), key=lambda r: -r.b)
    if not tops:
        return spark.createDataFrame([], SCHEMA)
    # the range that a guest from each range goes to: the one before it in descending order
    before = {r.b: tops[i - 1].b for i, r in enumerate(tops)}
    is_top = F.col("key").isin([r.top for r in tops])
    goal = F.create_map(*[F.lit(x) for r in tops for x in (r.b, before[r.b])])
    d = d.withColumn("bucket", bucket.cast("int"))
    own = d.withColumn("guest", F.lit(False))
    tie = F.xxhash64("text")
    guests = d.filter(is_top).groupBy("bucket").agg(F.max_by("text", F.struct(F.col("key"), -tie)).alias("text"), F.max("key").alias("key"))
    guests = guests.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(-(1 << 63)).alias("key"), goal[F.col("bucket")].cast("int").alias("bucket"), F.lit(True).alias("guest"))
    rows = own.select("doc_id", "text", "key", "bucket", "guest").union(guests)
    rows = rows.withColumn("tie", F.xxhash64("text")).repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc("key"), "tie", "text")
    return rows.select("doc_id", "text", "bucket", "guest").mapInArrow(lean(functools.partial(_follow, sparse)), SCHEMA)


def _cuts(d: DataFrame, parts: int) -> list[int]:
    """Range borders of about equal shares, from approximate percentiles; at most MOST_RANGES (larger ranges are sorted on disk and read as streams)."""
    n = min(2 * parts, MOST_RANGES)
    got = d.select(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 20_000)).first()[0]
    return sorted({int(x) for x in got or []})


def _rank(key, cuts: list[int], lo: int, hi: int):
    """Column: number of cuts not above the key, by binary search."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key >= cuts[mid], _rank(key, cuts, mid + 1, hi)).otherwise(_rank(key, cuts, lo, mid))
