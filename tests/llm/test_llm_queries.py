"""The registered queries on the small tables."""

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from sparkloom.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


#: Whose rows are counted; op7 repeats documents, op11 has five rows for each query.
TABLE = {"op5_urls": ("pages", "page_id"), "op13_turns": ("conversations", "conv_id")}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op7_mixing", "op11_pivots"}))
def test_every_document_page_or_conversation_has_one_row(spark, name):
    table, key = TABLE.get(name, ("documents", "doc_id"))
    rows = spark.read.parquet(f"{DATA}/{table}.parquet").select(key)
    rows = rows.distinct() if key == "conv_id" else rows
    assert Counter(r[0] for r in queries.QUERIES[name](spark, DATA).select(key).collect()) == Counter(r[0] for r in rows.collect())


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and out.where("not lossless").count() == 0 and corpus_pipeline.ORACLE_SQL is None
    assert len(corpus_pipeline.STAGES) == 5
