"""Neighbourhoods, pages and layout of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2, directed: bool = False) -> DataFrame:
    """(node, depth): nodes within ``hops`` of the seeds by undirected or outgoing edges (source, target); depth of first discovery."""
    ways = edges.select("source", "target")
    if not directed:
        ways = ways.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    seen = seeds.select("node", F.lit(0).alias("depth"))
    frontier = seeds.select("node")
    for depth in range(1, hops + 1):
        found = ways.join(frontier.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        frontier = found.join(seen, "node", "left_anti")
        seen = seen.unionByName(frontier.select("node", F.lit(depth).alias("depth")))
    return seen


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


def after(rows: DataFrame, keys: list[str], cursor: tuple, size: int) -> DataFrame:
    """Keyset paging: the rows after ``cursor`` in the order of ``keys``."""
    later = F.struct(*keys) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, cursor, strict=True)])
    return rows.filter(later).orderBy(*keys).limit(size)


def page_of(rows: DataFrame, key: str, value: object, size: int) -> DataFrame:
    """The page (in the order of ``key``) that holds ``value``: the count of smaller keys gives its offset."""
    before = rows.filter(F.col(key) < value).count()
    return rows.orderBy(key).offset(before // size * size).limit(size)


def grid(nodes: DataFrame, kind: str, key: str, columns: int = 10, step: int = 100) -> DataFrame:
    """Coordinates by kind: each kind a band, its nodes in rows of ``columns``."""
    kinds = nodes.select(kind).distinct().withColumn("band", F.row_number().over(Window.orderBy(kind)) - 1)
    n = F.row_number().over(Window.partitionBy(kind).orderBy(key)) - 1
    placed = nodes.withColumn("n", n).join(kinds, kind)
    return placed.select(key, kind, (F.col("n") % columns * step).alias("x"), (F.col("band") * 10_000 + F.floor(F.col("n") / columns).cast("int") * step).alias("y"))
