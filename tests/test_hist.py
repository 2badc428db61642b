"""Histogram algebra and buckets on literals that can be checked by hand."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlake.functions import buckets, hist
from emberlake.plans.search import compiler, parser


@pytest.fixture(scope="module")
def ev(spark):
    one = spark.range(1)

    def run(c):
        return one.select(c.alias("x")).first().x

    return run


def longs(*xs):
    return F.array(*(F.lit(x).cast("long") for x in xs)).cast("array<bigint>") if xs else F.array().cast("array<bigint>")


def doubles(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_kernels(ev):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert ev(hist.linear(*lit(10, 20, 0, 4, 1))) == 12.5
    assert ev(hist.linear(*lit(10, 20, 0, 0, 1))) == 10
    assert ev(hist.log_linear(*lit(1, 4, 0, 2, 1))) == 2
    assert ev(hist.log_linear(*lit(0, 4, 0, 2, 1))) == 2
    assert ev(hist.log_linear(*lit(-4, -1, 0, 2, 1))) == -2


def test_explicit(ev):
    b, c = doubles(0.5, 1, 1.5, 2), longs(10, 20, 30, 25, 15)
    got = ev(hist.explicit_buckets(b, c))
    assert [(x.lo, x.hi, x.cnt) for x in got] == [(0.5, 0.5, 10), (0.5, 1, 20), (1, 1.5, 30), (1.5, 2, 25), (2, 2, 15)]
    assert ev(hist.explicit_quantile(b, c, 0.5)) == pytest.approx(1 + 0.5 * 20 / 30)
    assert ev(hist.explicit_quantile(b, longs(0, 0, 0, 0, 0), 0.5)) is None
    assert ev(hist.explicit_quantile(b, c, 1.0)) == 2


def test_exponential(ev):
    p = ev(hist.positive_buckets(F.lit(0), F.lit(1), longs(5, 6)))
    assert [(x.lo, x.hi) for x in p] == [(2, 4), (4, 8)]
    n = ev(hist.negative_buckets(F.lit(0), F.lit(0), longs(2, 3)))
    assert [(x.lo, x.hi, x.cnt) for x in n] == [(-4, -2, 3), (-2, -1, 2)]
    assert ev(hist.zero_cutoff(F.lit(0.125), F.lit(3))) == -25
    assert ev(hist.zero_cutoff(F.lit(0.0), F.lit(3))) is None


def test_vectors(ev):
    assert ev(hist.add_vectors(F.array(longs(1, 2), longs(1, 1, 5)))) == [2, 3, 5]
    assert ev(hist.subtract_vectors(longs(3, 3), longs(1, 2))) == [2, 1]
    assert ev(hist.subtract_vectors(longs(3, 3), longs(4, 2))) is None
    assert ev(hist.pad_left(longs(1), F.lit(3), F.lit(1))) == [0, 0, 1]
    assert ev(hist.pad_left(longs(1), F.lit(1), F.lit(3))) == [1]
    f = ev(hist.fold_below(longs(1, 2, 3), F.lit(-1), F.lit(0)))
    assert (f.counts, f.offset, f.folded) == ([3], 1, 3)
    f = ev(hist.fold_below(longs(1, 2), F.lit(5), F.lit(0)))
    assert (f.counts, f.offset, f.folded) == ([1, 2], 5, 0)
    e = ev(hist.extents(hist.explicit_buckets(doubles(1, 2), longs(0, 4, 0))))
    assert (e["min"], e["max"]) == (1, 2)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), max_size=12), st.integers(-20, 20), st.integers(0, 3))
def test_downscale_keeps_every_count(ev, counts, offset, levels):
    got = ev(hist.downscale(longs(*counts), F.lit(offset).cast("long"), F.lit(levels)))
    want: dict[int, int] = {}
    for i, c in enumerate(counts):
        k = math.floor((offset + i) / 2**levels)
        want[k] = want.get(k, 0) + c
    assert {got.offset + i: c for i, c in enumerate(got.counts or [])} == (want if levels or counts else {})
    if levels or counts:
        assert got.offset == math.floor(offset / 2**levels)


def test_ladder():
    assert buckets.width_of(100 * 60 * 10**9, 100) == buckets.MIN
    assert buckets.width_of(10, 0) is None
    assert buckets.width_of(1_767_225_600 * 10**9, 400) == 4_504_464_000_000_000


@pytest.mark.parametrize(
    ("span", "target", "width"),
    [
        (32801 * 7919000001, 2, 216_275_559_516_400),  # half-way between ...400 and ...401
        (10**17 - 1, 10**11 - 1, buckets.MS),  # as a double, the span is 10**17: one bucket too many
        (10**17, 10**11 - 1, 10 * buckets.MS),
        (0, 10, None),
    ],
)
def test_ladder_column(ev, span, target, width):
    assert ev(buckets.width_column(F.lit(span).cast("long"), F.lit(target).cast("long"))) == width
    assert buckets.width_of(span, target) == width


def test_repeated_hour_is_the_later_one(ev):
    wall = 1_792_891_800 * 10**9  # 2026-10-25 01:30
    assert ev(buckets.to_utc(F.lit(wall), "Europe/London")) == wall
    assert ev(buckets.to_utc(F.lit(wall - 86_400 * 10**9), "Europe/London")) == wall - 90_000 * 10**9


def test_floor_div(ev):
    assert [ev(buckets.floor_div(F.lit(a).cast("long"), 10)) for a in (-11, -10, -1, 0, 9, 2**60 + 7)] == [-2, -1, -1, 0, 0, (2**60 + 7) // 10]


def test_parser():
    f = compiler.SPAN_FIELDS
    tree = parser.parse("name = a OR name = b AND kind = c", f)
    assert tree.operator == "AND" and tree.children[0].operator == "OR"
    assert parser.parse("two words", f).field.scope == "global"
    assert parser.parse("duration > 1.5s", f).value == "1500000000"
    assert parser.parse("name NOT IN [a, 'b', ]", f).value == ["a", "b"]
    for bad in ("name =", "(name = a", "name = a b = c", "nope = 1", "name > 3", "name = a)"):
        with pytest.raises(parser.SearchError):
            parser.parse(bad, f)
    assert parser.from_wire(parser.to_wire(tree)) == tree


def test_hostile_text_is_data(spark):
    df = spark.createDataFrame([("a' OR 1=1 --", "1"), ("b", "2")], "name string, span_id string")
    hit = compiler.matching(df, parser.Condition(parser.Field("name"), "=", "x' OR '1'='1"), compiler.SPANS)
    assert hit.count() == 0
    assert compiler.matching(df, parser.Condition(parser.Field("name"), "CONTAINS", "' OR"), compiler.SPANS).count() == 1


def test_array_conditions(ev):
    a = F.lit("[1,2,3]")
    yes = [("=", "[1, 2, 3]"), ("CONTAINS", "2"), ("IN", "[3, 1]"), ("NOT CONTAINS", "7"), ("NOT IN", "[1, 7]"), ("!=", "[1]")]
    assert all(ev(compiler.compare_array(a, op, v, "int64[]")) for op, v in yes)
