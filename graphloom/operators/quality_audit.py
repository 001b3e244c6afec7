"""Graph audits: one DataFrame of findings per rule, (severity, code, record_id, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.staging import stage


def finding(rows: DataFrame, severity: str, code: str, record_id: Column, detail: Column) -> DataFrame:
    return rows.select(
        F.lit(severity).alias("severity"), F.lit(code).alias("code"), record_id.cast("string").alias("record_id"), detail.cast("string").alias("detail")
    )


def all_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def orphans(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities that nothing mentions."""
    return entities.join(mentions.select("entity_id").distinct(), "entity_id", "left_anti")


def isolated(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities on no edge."""
    return entities.join(edges.select(F.col("object").alias("entity_id")).distinct(), "entity_id", "left_anti")


def hubs(edges: DataFrame, threshold: int, inclusive: bool) -> DataFrame:
    """(entity_id, degree) of entities with more (or, inclusive, as many) neighbours than the threshold."""
    degree = edges.groupBy(F.col("subject").alias("entity_id")).agg(F.count_distinct("object").alias("degree"))
    return degree.filter(F.col("degree") >= threshold if inclusive else F.col("degree") > threshold)


def endpoint_cardinality(entities: DataFrame, edges: DataFrame, least: int, most: int) -> DataFrame:
    """(entity_id, n): entities whose number of distinct objects lies outside least..most, those without any included."""
    counts = edges.groupBy(F.col("subject").alias("c_id")).agg(F.count_distinct("object").alias("n"))
    all_counts = entities.join(counts, F.col("entity_id") == F.col("c_id"), "left").select("entity_id", F.coalesce("n", F.lit(0)).alias("n"))
    return all_counts.filter(~F.col("n").between(least, most))


def property_cardinality(entities: DataFrame, facts: DataFrame, required: bool, single: bool) -> DataFrame:
    """(entity_id, code): missing required properties and several meanings of single-valued ones."""
    counts = facts.groupBy(F.col("subject").alias("c_id")).agg(F.count_distinct("signature").alias("n"))
    n = F.coalesce("n", F.lit(0))
    code = F.when(F.lit(required) & (n == 0), "REQUIRED_ENTITY_PROPERTY_MISSING").when(F.lit(single) & (n > 1), "ENTITY_PROPERTY_CARDINALITY_INVALID")
    return entities.join(counts, F.col("entity_id") == F.col("c_id"), "left").select("entity_id", code.alias("code")).filter("code IS NOT NULL")


def hierarchy(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, depth, root) below the roots of child -> parent edges, level by level to the last.

    A node that is reached by ways of several lengths has a row for each of these depths, and one only for ways of one length. Nodes on
    cycles, or between two, never appear, and nothing is reached through them. Null ends are no edges.
    """
    edges = stage(edges.select("child", "parent").dropna().distinct(), "hierarchy-edges")
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    level = stage(roots.select("node", F.lit(0).alias("depth"), F.col("node").alias("root")), "hierarchy-level")
    edges = stage(edges.join(in_cycles(edges).select(F.col("node").alias("child")), "child", "left_anti"), "hierarchy-edges")
    out, depth = level, 0
    while level.limit(1).count():
        depth += 1
        level = stage(edges.join(level.select(F.col("node").alias("parent"), "root"), "parent").select(
            F.col("child").alias("node"), F.lit(depth).alias("depth"), "root"
        ).distinct(), "hierarchy-level")
        out = out.unionByName(level)
    return out


def in_cycles(edges: DataFrame) -> DataFrame:
    """(node): what is left after removing nodes without parents and nodes without children until nothing changes."""
    left = stage(edges.select("child", "parent").distinct(), "cycle-edges")
    before, n = None, left.count()
    while n not in (0, before):
        left = left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        left = stage(left.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("child", "parent"), "cycle-edges")
        before, n = n, left.count()
    return left.select(F.col("child").alias("node")).distinct()
