"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1 (piecewise linear knots),
by default those of ``SCHEDULES`` in turn: source number i, in order of name, has schedule
i mod 3, which falls from 3 to 1, is flat, or rises from 1 to 3. Its integral is the
source's demand, scaled to its target of words. Inverting the cumulative demand at the words that a source has given so far yields the
training position of each document, and documents are range-sorted by position.

A source gives its documents in a fixed pseudo-random order, lap after lap, until its
target is met; the last lap ends inside a document, which then gives only part of its
words. Targets share ``factor`` times all words by weight; none exceeds ``most`` times
its source's words, the excess being shared again by weight among the others.

A source may hold any share of the rows: running sums go over hash buckets of a source
first, then over bucket totals, so no task orders a whole source. Source totals form a
table of one row for each source.

Defined results: null and empty texts have size 0 and give nothing; a null source is a
source of its own, last in order; documents are ordered by a digest of their doc_id (of
their text where it is null), then by doc_id, size and a digest of the whole row, and exact
repeats are documents of their own; extra columns are ignored; an empty table gives an empty result; if no document has words all
targets are 0. Reruns agree, as order depends on content only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.scratch import Scratch
from emberlake.llm.tables import row_key

WEIGHTS = (3, 1, 2)
FACTOR, MOST = 1.5, 2
BUCKET_HEX = 3  # hex digits of the order key that name a bucket: 4096 buckets a source
FLAT = ((0.0, 1.0), (1.0, 1.0))
SCHEDULES = (((0.0, 3.0), (1.0, 1.0)), FLAT, ((0.0, 1.0), (1.0, 3.0)))
ROW = ("source", "doc_id", "text")  # what tells rows apart; equal ones are counted
Knots = Sequence[tuple[float, float]]


def words(text: Column) -> Column:
    """Number of words: starts of non-white runs."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, factor: float = FACTOR, most: int = MOST) -> DataFrame:
    """(source, source_no, source_size, weight, target) from documents' (source, size).

    Sharing the excess again and again ends where each target is the least of its cap and
    level * weight; the level follows from prefix sums in the order of cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    per = per.withColumn("n", order).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    every = Window.partitionBy()
    per = per.withColumn("capped", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("rest", F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.lit(factor) * F.sum("source_size").over(every) - F.col("capped")) / F.col("rest"))
    # the first source in this order that stays under its cap sets the level of all after it
    open_ = F.col("level") * F.col("weight") <= F.col("cap")
    per = per.withColumn("level", F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), "n", "level"))).over(every)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return per.select("source", F.col("n").alias("source_no"), "source_size", "weight", target.alias("target"))


def demand(x: Column, knots: Knots) -> Column:
    """Position in 0 to 1 at which the share ``x`` of a source's demand is used up: the inverse of its integrated schedule."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    total, done = sum(areas), 0.0
    out = F.lit(float(knots[-1][0]))
    pieces = []
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        if area <= 0:
            continue
        left = x * total - done
        slope = (w1 - w0) / (t1 - t0)
        # left = w0 * d + slope * d * d / 2, solved for d in a form that is stable for small slopes
        d = F.try_divide(2 * left, w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * left, F.lit(0.0))))
        pieces.append(((done + area) / total, F.lit(float(t0)) + F.coalesce(d, F.lit(0.0))))
        done += area
    for share, at in reversed(pieces):
        out = F.when(x <= share, at).otherwise(out)
    return out


def laps(docs: DataFrame, weights: Sequence[int] = WEIGHTS, factor: float = FACTOR, most: int = MOST) -> DataFrame:
    """``docs`` (doc_id, source, text, ...) with size, source_size, target, before (words of its source ahead of it in a lap) and taken.

    Carries only doc_id, source, an order key and the row's identity: the texts are read once, and what
    is left of them is stored for the sums that follow.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.coalesce("text", F.lit("")))))
    d = docs.select("doc_id", "source", words(F.col("text")).alias("size"), key.alias("key"), row_key(*ROW).alias("row"))
    d = Scratch(docs.sparkSession, "laps").keep(d, "slim")
    goal = targets(d.select("source", "size"), weights, factor, most)
    bucket = F.substring("key", 1, BUCKET_HEX)
    d = d.withColumn("bucket", bucket)
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    totals = d.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("outer", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0))).select(F.col("source").alias("s1"), F.col("bucket").alias("b1"), "outer")
    goal = goal.select(F.col("source").alias("s2"), "source_no", "source_size", "target")
    d = d.join(totals, F.col("source").eqNullSafe(F.col("s1")) & (F.col("bucket") == F.col("b1"))).join(goal, F.col("source").eqNullSafe(F.col("s2")))
    d = d.withColumn("before", F.col("inner") + F.col("outer"))
    size, total = F.col("size"), F.col("source_size")
    whole = F.when(total > 0, F.floor(F.floor("target") / total)).otherwise(0)
    rest = F.floor("target").cast("long") - whole * total
    taken = whole * size + F.greatest(F.lit(0), F.least(size, rest - F.col("before")))
    return d.select("doc_id", "source", "source_no", "key", "row", "size", "source_size", "target", "before", taken.cast("long").alias("taken"))


def _copies(schedules: Sequence[Knots]) -> Column:
    """(copy, words, position) of each copy that `laps` takes of a row; none if it takes no words."""
    size, taken = F.col("size"), F.col("taken")

    def one(copy: Column) -> Column:
        x = F.least(F.lit(1.0), (copy * F.col("source_size") + F.col("before")) / F.greatest(F.col("target"), F.lit(1.0)))
        turn = F.col("source_no") % len(schedules)
        at = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            at = F.when(turn == i, demand(x, knots)).otherwise(at)
        return F.struct(copy.alias("copy"), F.least(size, taken - copy * size).alias("words"), at.alias("position"))

    none = F.array().cast("array<struct<copy:bigint,words:bigint,position:double>>")
    return F.when(taken > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(taken / size) - 1), one)).otherwise(none)


def curriculum(mixed: DataFrame, *schedules: Knots) -> DataFrame:
    """A row for each copy that `laps` takes: copy (0, 1, ...), words of it, position in training time; range-sorted by position."""
    rows = mixed.withColumn("of", F.explode(_copies(schedules or SCHEDULES))).select(*mixed.columns, "of.*")
    return rows.repartitionByRange("position", "key", "copy").sortWithinPartitions("position", "key", "copy")


def in_training_order(mixed: DataFrame, *schedules: Knots) -> DataFrame:
    """The rows of `laps`, range-sorted by the ``position`` of their first copy (those not taken last), ``taken`` added up from the copies."""
    of = mixed.withColumn("of", _copies(schedules or SCHEDULES))
    taken = F.aggregate("of", F.lit(0).cast("long"), lambda sum_, c: sum_ + c["words"])
    rows = of.withColumn("taken", taken).withColumn("position", F.try_element_at("of", F.lit(1))["position"]).drop("of")
    by = F.col("position").asc_nulls_last(), F.col("key"), F.col("row")
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def mixed_documents(docs: DataFrame, *schedules: Knots, **how) -> DataFrame:
    """``docs`` with rows repeated or left out so that sources come near their targets, in the order of `curriculum`, columns as they are.

    Documents stay whole: of a document that a lap would cut, the copy stays if at least
    half of it is taken. Rows are known by source, doc_id and text, nulls included; equal
    ones are told apart by a number among them.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    m = laps(docs, **how)
    equal = Window.partitionBy("row")
    m = m.withColumn("equal", F.count(F.lit(1)).over(equal)).withColumn("tie", F.row_number().over(equal.orderBy("before", "taken")))
    dealt = m.withColumn("of", F.explode(_copies(schedules or SCHEDULES))).filter("2 * of.words >= size")
    dealt = scratch.keep(dealt.select("row", "tie", "equal", "key", F.col("of.copy").alias("copy"), F.col("of.position").alias("at")), "dealt")
    known = docs.select(F.struct("*").alias("whole"), row_key(*ROW).alias("row"))  # no name of the table meets those used here
    alone, several = dealt.filter("equal = 1").drop("equal", "tie"), dealt.filter("equal > 1").drop("equal")
    out = known.join(alone.hint("merge"), "row").select("whole", "at", "key", "copy")
    if not several.isEmpty():  # only rows that have equals are numbered; where there are none texts travel once less
        number = F.row_number().over(Window.partitionBy("row").orderBy(F.xxhash64("whole")))
        numbered = known.join(several.select("row").distinct().hint("merge"), "row", "left_semi").withColumn("tie", number)
        out = out.union(numbered.join(several, ["row", "tie"]).select("whole", "at", "key", "copy"))
    return out.repartitionByRange("at", "key", "copy").sortWithinPartitions("at", "key", "copy").select("whole.*")
