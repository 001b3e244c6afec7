"""Document, chunk and graph views derived from the supplied tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import load

CHUNK_CHARS = 1200


def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One governed version per document: identity, checksum, access groups, lifecycle and publication time."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("document_id"),
        F.col("doc_id").alias("version_id"),
        F.lit("t0").alias("tenant_id"),
        F.array("source").alias("access_groups"),
        F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 17 == 0, "RETIRED").when(F.col("doc_id") % 5 != 0, "ACTIVE").alias("lifecycle"),
        F.when(F.col("doc_id") % 11 != 0, F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,doc_id)")).alias("published_at"),
        "text",
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, entity_id, confidence): orders mention the parts of their lines."""
    return load(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id")
    ).agg(F.round(1 - F.max("l_discount"), 6).alias("confidence"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("entity_type"),
        F.concat(F.lit("part-id:"), F.col("p_partkey")).alias("canonical_key"), F.col("p_name").alias("canonical_name"),
        F.array("p_brand").alias("aliases"),
    )


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, predicate, object): the suppliers' distinct SUPPLIES assertions."""
    l = load(spark, sf_dir, "lineitem")
    return l.select(F.col("l_suppkey").alias("subject"), F.lit("SUPPLIES").alias("predicate"), F.col("l_partkey").alias("object")).distinct()


#: The review status that each kind of event stands for.
EVENT_STATUS = {"click": "PENDING", "view": "APPROVED", "purchase": "PUBLISHED", "signup": "REJECTED", "error": "QUARANTINED"}


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, revision, ts, event_id, status, value): the revision chain of each record."""
    from pyspark.sql import Window

    e = load(spark, sf_dir, "events").withColumn("record_id", F.concat_ws(":", "user_id", "event_type"))
    status = F.create_map(*[F.lit(x) for pair in EVENT_STATUS.items() for x in pair])[F.col("event_type")]
    order = Window.partitionBy("record_id").orderBy("ts", "event_id")
    return e.select("record_id", F.row_number().over(order).alias("revision"), "ts", "event_id", status.alias("status"), "value")


REVISIONS_SQL = """revisions AS (
  SELECT user_id || ':' || event_type AS record_id,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INT AS revision, ts, event_id,
         CASE event_type WHEN 'click' THEN 'PENDING' WHEN 'view' THEN 'APPROVED' WHEN 'purchase' THEN 'PUBLISHED'
              WHEN 'signup' THEN 'REJECTED' WHEN 'error' THEN 'QUARANTINED' END AS status, value
  FROM events)"""

VERSIONS_SQL = """versions AS (
  SELECT doc_id AS document_id, doc_id AS version_id, 't0' AS tenant_id, [source] AS access_groups, lang AS language,
         CASE WHEN doc_id % 17 = 0 THEN 'RETIRED' WHEN doc_id % 5 <> 0 THEN 'ACTIVE' END AS lifecycle,
         CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id) END AS published_at, text
  FROM documents)"""

MENTIONS_SQL = """mentions AS (
  SELECT l_orderkey AS chunk_id, l_partkey AS entity_id, round(1 - max(l_discount), 6) AS confidence
  FROM lineitem GROUP BY 1, 2)"""

SUPPLIES_SQL = "supplies AS (SELECT DISTINCT l_suppkey AS subject, 'SUPPLIES' AS predicate, l_partkey AS object FROM lineitem)"
