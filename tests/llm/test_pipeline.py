"""The pipeline over a small table, and the registered queries against their SQL."""

import glob
import os
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from spanlake.llm.catalog import ORACLES, QUERIES  # noqa: E402
from spanlake.llm.common import clear, written  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(expected)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DATA), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        assert docs.where("n_chars <> char_length(text)").count() == 0
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.select("doc_id").distinct().count() == before
    assert corpus_pipeline.run(spark, DATA).count() == last.count()
    clear(spark)


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), name)
        assert docs.count() == 0
