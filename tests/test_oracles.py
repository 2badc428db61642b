"""Every registered query of the engine against its SQL twin, over the smallest data."""

import os

import duckdb
import pytest

from emberlake.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def order(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=order)
    got = duck.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=order)
    assert ours == theirs


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_zone_offsets_beyond_the_ns_of_a_long(spark, tmp_path):
    """Event ids of large tables lead past the year 2262."""
    spark.createDataFrame([(i,) for i in (0, 5_000, 2_383_999, 2_384_500, 5_999_999, 50_000_000)], "event_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    ours = QUERIES["zone_offsets"](spark, str(tmp_path)).select("event_id", "zone", "offset_ns").collect()
    theirs = con.execute(f"select event_id, zone, offset_ns from ({ORACLES['zone_offsets']})").fetchall()
    assert len(ours) == 24 and sorted(map(tuple, ours)) == sorted(theirs)
