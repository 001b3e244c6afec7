"""Queries over whole tables: every row of the tables counts."""

from __future__ import annotations

from graphloom.plans.catalog import QUERIES
from graphloom.sources.tables import load

SMALL = "/root/testdata/sf0.001"


def test_every_document_version_and_edge_counts(spark):
    documents = {r.doc_id for r in load(spark, SMALL, "documents").select("doc_id").collect()}
    in_time = {i for i in documents if i % 11 and i <= 300}
    assert {r.document_id for r in QUERIES["version_filter_whole"](spark, SMALL).collect()} == in_time
    assert any(i % 2 for i in in_time)
    supplied = {r.l_partkey for r in load(spark, SMALL, "lineitem").select("l_partkey").collect()}
    parts = {r.p_partkey for r in load(spark, SMALL, "part").select("p_partkey").collect()}
    assert {r.entity_id for r in QUERIES["isolated_entities_whole"](spark, SMALL).collect()} == parts - supplied


def test_an_artifact_of_any_earlier_document_counts(spark, tmp_path):
    rows = [(3, "same", "en"), (5, "same", "en"), (6, "new", "en"), (7, "other", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["incremental_inputs_whole"](spark, str(tmp_path)).count() == 1
