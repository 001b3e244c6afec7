"""Bounded training samples, shared by the learned operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_label: int) -> Iterator[tuple[str, int]]:
    """At most ``per_label`` different (text, label) rows of each label, whole, one after the other, for the driver.

    Rows of the held-out fold (crc32 of doc_id as text, mod ``folds``) and empty texts are left out. Texts count once
    however often they occur; those with the smallest hash are taken, in order of their hash, so the choice is the same at any
    partitioning. ``per_label`` bounds the rows; the driver fetches a partition of them at a time.
    """
    known = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & (F.pmod(common.crc32_of_id("l_id"), F.lit(folds)) != held_out)
    )
    text_hash = F.xxhash64(F.lit(11), "text")
    hashed = docs.select("doc_id", text_hash.alias("h")).filter(F.octet_length("text") > 0)
    # Ids and hashes alone are joined and sorted; texts move only for the rows that are chosen.
    rows = common.stage(hashed.join(known, F.col("doc_id") == F.col("l_id")).select("l_id", "label", "h"), "labelled")
    different = rows.select("label", "h").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    chosen = rows.select("l_id", "label", "h").limit(0)
    # A hash bound chosen from the counts keeps the sorts small however many rows are labelled.
    for value, n in sorted((r["label"], r["n"]) for r in different.collect()):
        share = min(1.0, 1.5 * per_label / n + 1e-4)
        bound = int(-(1 << 63) + share * ((1 << 64) - 1))
        some = rows.filter((F.col("label") == value) & (F.col("h") <= min(bound, (1 << 63) - 1)))
        first = some.groupBy("h").agg(F.min("l_id").alias("l_id")).orderBy("h").limit(per_label)
        chosen = chosen.unionByName(first.withColumn("label", F.lit(value)))
    # At most per_label rows of two labels.
    here = (F.col("doc_id") == F.col("l_id")) & (text_hash == F.col("h"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), here).select("label", "h", "text").dropDuplicates(["label", "h"])
    for r in common.stage(texts, "sample").orderBy("h", "label").toLocalIterator():
        yield r["text"], r["label"]
