"""Histogram algebra as Column expressions over arrays: buckets, quantiles, scales, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = "array<struct<lo:double,hi:double,cnt:bigint>>"
VECTOR = "array<bigint>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: the optimizer would put a copy wherever it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def linear(lo: Column, hi: Column, before: Column, cnt: Column, target: Column) -> Column:
    """Straight-line position of ``target`` in a bucket of ``cnt`` observations; an empty bucket gives its low edge."""
    return F.when(F.coalesce(cnt, F.lit(0)) == 0, lo).otherwise(lo + (hi - lo) * (target - before) / cnt)


def log_linear(lo: Column, hi: Column, before: Column, cnt: Column, target: Column) -> Column:
    """Geometric position, for buckets whose edges grow by a factor; straight where an edge is zero or signs differ."""
    grows = F.signum(lo) * F.signum(hi) > 0
    return F.when(F.coalesce(cnt, F.lit(0)) == 0, lo).when(grows, lo * F.pow(hi / lo, (target - before) / cnt)).otherwise(linear(lo, hi, before, cnt, target))


def _bucket(lo: Column, hi: Column, cnt: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), cnt.cast("long").alias("cnt"))


def explicit_buckets(bounds: Column, counts: Column) -> Column:
    """Buckets of an explicit histogram; the open outer ones shrink to the nearest bound."""
    n = F.size(bounds)

    def one(c: Column, i: Column) -> Column:
        lo = F.get(bounds, F.greatest(i - 1, F.lit(0)))
        hi = F.get(bounds, F.least(i, n - 1))
        return _bucket(lo, hi, c)

    return F.transform(counts, one)


def _edge(scale: Column, index: Column) -> Column:
    return F.pow(F.lit(2.0), F.pow(F.lit(2.0), -scale) * index)


def positive_buckets(scale: Column, offset: Column, counts: Column) -> Column:
    return F.transform(counts, lambda c, i: _bucket(_edge(scale, offset + i), _edge(scale, offset + i + 1), c))


def negative_buckets(scale: Column, offset: Column, counts: Column) -> Column:
    """Mirror image, most negative first."""
    n = F.size(counts)
    return F.transform(F.reverse(counts), lambda c, i: _bucket(-_edge(scale, offset + n - i), -_edge(scale, offset + n - i - 1), c))


def zero_bucket(count: Column) -> Column:
    return F.array(_bucket(F.lit(0.0), F.lit(0.0), F.coalesce(count, F.lit(0))))


def exponential_buckets(scale: Column, neg_offset: Column, neg: Column, zero: Column, pos_offset: Column, pos: Column) -> Column:
    none = F.array().cast(BUCKETS)
    return F.concat(F.coalesce(negative_buckets(scale, neg_offset, neg), none), zero_bucket(zero), F.coalesce(positive_buckets(scale, pos_offset, pos), none))


def total(buckets: Column) -> Column:
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda s, b: s + F.coalesce(b.cnt, F.lit(0)))


def quantile(buckets: Column, q: float, kernel=linear, n: Column | None = None) -> Column:
    """Value at rank q of ``n`` (by default all) observations: one pass that carries the running count and takes its answer at the first bucket that reaches it."""
    return let(buckets, lambda b: let(total(b) if n is None else n, lambda m: _at_rank(b, q, kernel, m)))


def _at_rank(buckets: Column, q: float, kernel, n: Column) -> Column:
    target = F.lit(float(q)) * n
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("value"))

    def step(s: Column, b: Column) -> Column:
        seen = s.seen + F.coalesce(b.cnt, F.lit(0))
        here = s.value.isNull() & (b.cnt > 0) & (seen >= target)
        return F.struct(seen.alias("seen"), F.when(here, kernel(b.lo, b.hi, s.seen, b.cnt, target)).otherwise(s.value).alias("value"))

    return F.when(n > 0, F.aggregate(buckets, start, step).value)


def all_quantiles(buckets: Column, qs: Sequence[float], kernel=linear) -> Column:
    """Map from each q to its value; buckets and their total are made once."""
    return let(buckets, lambda b: let(total(b), lambda n: quantiles(lambda q: _at_rank(b, q, kernel, n), qs)))


def explicit_quantile(bounds: Column, counts: Column, q: float) -> Column:
    ok = (F.size(bounds) > 0) & (F.size(counts) > 0)
    return F.when(ok, quantile(explicit_buckets(bounds, counts), q, linear))


def exponential_quantile(scale: Column, neg_offset: Column, neg: Column, zero: Column, pos_offset: Column, pos: Column, q: float) -> Column:
    return quantile(exponential_buckets(scale, neg_offset, neg, zero, pos_offset, pos), q, log_linear)


def quantiles(of, qs: Sequence[float]) -> Column:
    """Map from each q to its value; ``of`` gives the expression for one q."""
    if not qs:
        return F.lit(None).cast("map<double,double>")
    return F.map_from_arrays(F.array(*(F.lit(float(q)) for q in qs)), F.array(*(of(q) for q in qs)))


def extents(buckets: Column) -> Column:
    """Lowest and highest edge of the buckets that hold something; null if none does."""

    def finite(x: Column) -> Column:
        return F.abs(x) < float("inf")

    def of(full: Column) -> Column:
        low = F.array_min(F.transform(full, lambda b: F.when(finite(b.lo), b.lo).otherwise(0.0)))
        high = F.array_max(F.transform(full, lambda b: F.when(finite(b.hi), b.hi).otherwise(b.lo)))
        return F.when(F.size(full) > 0, F.struct(low.alias("min"), high.alias("max")))

    return let(F.filter(buckets, lambda b: b.cnt > 0), of)


def downscaled_offset(offset: Column, levels: Column) -> Column:
    """Index of a bucket after merging 2**levels neighbours (an arithmetic shift)."""
    return F.call_function("shiftright", offset.cast("long"), F.greatest(levels, F.lit(0)).cast("int"))


def downscale(counts: Column, offset: Column, levels: Column) -> Column:
    """struct(counts, offset) at a scale ``levels`` coarser, in one pass.

    Counts come in index order, so a bucket either adds to the newest coarse bucket or
    opens the next one: neighbours are at most one apart.
    """
    base = downscaled_offset(offset, levels)

    def place(i: Column) -> Column:
        return downscaled_offset(offset + i, levels) - base

    width = place(F.size(counts) - 1) + 1
    slots = F.sequence(F.lit(0).cast("long"), F.greatest(width - 1, F.lit(0)))
    step = F.pow(F.lit(2.0), F.greatest(levels, F.lit(0))).cast("long")

    def coarse(k: Column) -> Column:
        first = F.greatest((base + k) * step - offset, F.lit(0).cast("long"))
        last = F.least((base + k + 1) * step - offset, F.size(counts).cast("long"))
        part = F.slice(counts, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))
        return F.aggregate(part, F.lit(0).cast("long"), lambda s, c: s + c)

    merged = F.when(F.coalesce(F.size(counts), F.lit(0)) <= 0, counts).otherwise(F.transform(slots, coarse))
    moved = F.struct(merged.alias("counts"), base.alias("offset"))
    same = F.struct(counts.cast(VECTOR).alias("counts"), offset.cast("long").alias("offset"))
    return F.when(levels > 0, moved).otherwise(same)


def pad_left(counts: Column, offset: Column, target: Column) -> Column:
    """Zeros in front so that the first count stands at ``target``; never trims."""
    n = F.greatest(offset - target, F.lit(0)).cast("int")
    return F.concat(F.array_repeat(F.lit(0).cast("long"), n), counts)


def dense(cells: Column) -> Column:
    """Counts of sorted cells (idx, c) with zeros in the gaps; null for none."""

    def filled(x: Column) -> Column:
        gaps = F.transform(x, lambda a, i: F.array_repeat(F.lit(0).cast("long"), F.when(i > 0, a.idx - F.get(x, i - 1).idx - 1).otherwise(0).cast("int")))
        return F.flatten(F.zip_with(gaps, x, lambda g, a: F.concat(g, F.array(a.c))))

    whole = F.try_element_at(cells, F.lit(-1)).idx - F.get(cells, F.lit(0)).idx + 1 == F.size(cells)
    return F.when(F.size(cells) > 0, F.when(whole, F.transform(cells, lambda a: a.c)).otherwise(filled(cells)))


def add_vectors(vectors: Column) -> Column:
    """Element-wise sum of count arrays, short ones padded with zeros; null for none."""

    def added(some: Column) -> Column:
        total = F.aggregate(some, F.array().cast(VECTOR), lambda s, v: F.zip_with(s, v, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))))
        return F.when(F.size(some) > 0, total)

    return let(F.filter(vectors, lambda v: v.isNotNull()), added)


def subtract_vectors(a: Column, b: Column) -> Column:
    """a - b; a alone without b; null if any element falls (a restart)."""
    d = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    least = let(d, lambda v: F.when(F.coalesce(F.array_min(v), F.lit(0)) >= 0, v))
    return F.when(a.isNull(), F.lit(None).cast(VECTOR)).when(b.isNull(), a).otherwise(least)


def zero_cutoff(threshold: Column, scale: Column) -> Column:
    """Index of the last bucket that lies below a zero threshold.

    The logarithm's last bit may be off at powers of two, where the answer is exact: the
    nearest integer exponent is tried first.
    """
    e = F.round(F.log2(threshold))
    exact = F.pow(F.lit(2.0), e) == threshold
    lg = F.when(exact, e).otherwise(F.log2(threshold))
    return F.when(threshold > 0, F.floor(lg * F.pow(F.lit(2.0), scale)).cast("long") - 1)


def fold_below(counts: Column, offset: Column, cutoff: Column) -> Column:
    """struct(counts, offset, folded): buckets up to the cutoff leave the array, their sum is folded."""
    given = F.struct(counts.alias("counts"), offset.cast("long").alias("offset"), cutoff.alias("cutoff"))
    return let(given, lambda g: _folded(g.counts, g.offset, g.cutoff))


def _folded(counts: Column, offset: Column, cutoff: Column) -> Column:
    n = F.size(counts).cast("long")
    drop = F.least(cutoff - offset + 1, n)
    gone = F.slice(counts, 1, F.greatest(drop, F.lit(0)).cast("int"))
    left = F.slice(counts, (drop + 1).cast("int"), F.greatest(n - drop, F.lit(0)).cast("int"))
    folded = F.aggregate(gone, F.lit(0).cast("long"), lambda s, c: s + c)
    keep = F.coalesce(n, F.lit(0)) <= 0
    keep = keep | cutoff.isNull() | (cutoff < offset)
    same = F.struct(counts.alias("counts"), offset.alias("offset"), F.lit(0).cast("long").alias("folded"))
    return F.when(keep, same).otherwise(F.struct(left.alias("counts"), (offset + drop).cast("long").alias("offset"), folded.alias("folded")))


def zero_fold(counts: Column, offset: Column, threshold: Column, scale: Column) -> Column:
    return fold_below(counts, offset, zero_cutoff(threshold, scale))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))
