"""Registered queries against their SQL twins, and the pipeline, over the smallest data."""

import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from emberlake.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = con.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    theirs = sorted(map(str, got.fetchall()))
    ours = sorted(str(tuple(r)) for r in QUERIES[name](spark, DATA).select(names).collect())
    assert ours == theirs


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    """Each stage keeps the columns and its decisions take effect."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    kept, single, clean, mixed = counts[1:]
    assert counts[0] > kept > single == clean and mixed > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.filter("piece = 0").count() == mixed
    spark.catalog.clearCache()


def test_pipeline_gives_token_ids(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    rows = corpus_pipeline.pack_sequences(spark, docs, DATA).collect()
    assert rows and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
