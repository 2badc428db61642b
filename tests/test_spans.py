"""Whole traces are searched, all of them."""

import os

import pytest

from emberlake.operators import traces
from emberlake.plans.fixtures import derived
from emberlake.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_no_trace_is_left_out(spark):
    got = QUERIES["search_spans_matched"](spark, DATA).select("trace_id", "span_id").collect()
    want = derived(spark, DATA, "d_spans").select("trace_id", "span_id").collect()
    assert sorted(got) == sorted(want)


def test_against_brute_force(spark):
    rows = [(t, f"{i:02d}", None if i == 0 else f"{(i - 1) // 2:02d}", 100 * i + k, 100 * i + 50, "Error" if i % 3 == 0 else None) for k, t in enumerate("abcdefghijkl") for i in range(7)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, start_time long, end_time long, status_code string")
    got = {(r.trace_id, r.span_id, r.matched, r.offset_ns, r.duration_ns) for r in traces.search_spans(df, df.status_code == "Error").collect()}
    first = {t: min(r[3] for r in rows if r[0] == t) for t in "abcdefghijkl"}
    assert got == {(t, s, code == "Error", a - first[t], b - a) for t, s, _, a, b, code in rows}
