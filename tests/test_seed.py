"""Deep and malformed synthetic traces through the tree operators."""

from pyspark.sql import functions as F

from emberlake.operators import logs, metrics, traces
from emberlake.sources import seed


def test_seeded_trees(spark):
    s = seed.spans(spark, 30, 9, orphans=10, cycles=7).cache()
    tree = traces.span_tree(s)
    # in traces 0, 7, 14, 21 and 28 spans 2 and 3 form a ring (but trace 0, whose span 2 is an orphan instead): only the root is placed
    placed = {int(r.trace_id, 16): r["count"] for r in tree.groupBy("trace_id").count().collect()}
    assert {t for t, n in placed.items() if n == 1} == {7, 14, 21, 28} and all(n == 9 for t, n in placed.items() if t not in (7, 14, 21, 28))
    assert traces.search_spans(s).count() == s.count()
    whole = traces.search_spans(s).filter("salvaged").agg(F.count_if("cycle_point")).first()[0]
    assert whole == 4


def test_a_deep_chain(spark):
    rows = [("t", f"{i:04d}", f"{i - 1:04d}" if i else None, i) for i in range(300)]
    tree = traces.span_tree(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, start_time long"))
    assert {r.span_id: r.depth for r in tree.collect()} == {f"{i:04d}": i for i in range(300)}


def test_seeded_signals(spark):
    g = seed.gauge(spark, 3, 500)
    r = metrics.Request(target_buckets=20, fit_to_data=True, view_buckets=10, sparkline_buckets=20)
    got = metrics.get_metric(g, "Gauge", "", r)
    assert 0 < got["datapoints"].count() < 1500 and got["sparkline"].count() > 0 and got["series"].count() == 3
    assert logs.search_logs(seed.logs(spark, 100)).filter("effective_time = 0").count() == 0
