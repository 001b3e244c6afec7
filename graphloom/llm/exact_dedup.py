r"""Operator 9: exact dedup by content-defined chunk recipes (DataFrame functions only).

Each text is cut where its content says so: after a line end, after punctuation and a space that follow anything but certain lower-case
letters (so capitals, digits and letters of other scripts too), and after the punctuation of scripts that set no spaces. Chunks are
deduplicated by their bytes: map-side first, so that a chunk that all documents share reaches the shuffle once a task, then over
all documents. A chunk's identifier is its 64-bit hash, verified by that: an identifier of one chunk alone stands for these bytes.
Where several chunks share a hash, their bytes stay in the recipe beside it. So recipes (ordered identifier lists) are equal if
and only if the texts are, and from then on only recipes move, never texts. The SHA-256 is an output and decides nothing.

Defined results: a null text counts as empty, and empty texts equal one another. Of equal rows, the
one with the largest doc_id stays; of rows that share that id too, one stays. A null doc_id is
smaller than any other. An empty table gives no rows. Groups of any size are summed map-side; joins back to rows leave their
exchanges to adaptive skew handling. Columns are selected by name, so others may clash. A very long text is cut in one
task; a line without any place to cut is one chunk. ``docs`` is read more than once: a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Where a chunk ends: after a line end or a mark of full width, or after punctuation and a space behind anything but these letters.
CUT = r"(?<=\n)|(?<=[.,;:!?] )(?<=[^acefhijnoqrstwx\s]..)|(?<=[\u3001\u3002\uFF01-\uFF1F])"


def hash64(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _chunks(text_column: str, cut: str) -> Column:
    return F.split(F.coalesce(F.col(text_column), F.lit("")), cut, -1)


def recipes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cut: str = CUT, name=hash64) -> DataFrame:
    """(row, doc_id, text_sha256, recipe): recipe is the ordered list of the text's chunk identifiers."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col(text_column), F.lit("")).cast("binary"), 256)).alias("text_sha256"),
        F.transform(_chunks(text_column, cut), name).alias("recipe"),
    )


def shared_identifiers(docs: DataFrame, text_column: str = "text", cut: str = CUT, name=hash64) -> DataFrame:
    """(id): the identifiers that stand for more than one chunk, by the bytes of all chunks. Nearly always none."""
    each = docs.select(F.explode(_chunks(text_column, cut)).alias("chunk")).select(name(F.col("chunk")).alias("id"), "chunk")
    return each.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")


def _with_bytes(docs: DataFrame, found: DataFrame, shared: DataFrame, text_column: str, cut: str, name) -> DataFrame:
    """``found`` with ``second``: the chunks, in order, whose identifiers are not theirs alone."""
    rows = docs.select(F.monotonically_increasing_id().alias("s_row"), _chunks(text_column, cut).alias("chunks"))
    each = rows.select("s_row", F.posexplode("chunks").alias("at", "chunk"))
    some = each.join(shared, name(F.col("chunk")) == F.col("id"), "left_semi")
    kept = some.groupBy("s_row").agg(F.array_sort(F.collect_list(F.struct("at", "chunk"))).alias("second"))
    return found.join(kept, F.col("row") == F.col("s_row"), "left").drop("s_row")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cut: str = CUT, name=hash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``."""
    found = common.stage(recipes(docs, id_column, text_column, cut, name), "recipes")
    shared = common.stage(shared_identifiers(docs, text_column, cut, name), "shared-identifiers")
    keys = ["recipe"]
    if shared.limit(1).count():
        found = common.stage(_with_bytes(docs, found, shared, text_column, cut, name), "recipes")
        keys.append("second")
    keyed = found.withColumn("mark", F.xxhash64(*keys))
    groups = keyed.groupBy("mark", *keys).agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    # Joined on fewer columns than they are grouped by: both sides then have exchanges that Spark may split.
    g = groups.select(F.col("mark").alias("g_mark"), *[F.col(k).alias(f"g_{k}") for k in keys], "last", "group_size")
    same = F.col("mark") == F.col("g_mark")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"g_{k}"))
    return keyed.join(g, same).select(
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("last.row")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.h AS text_sha256
FROM t JOIN g ON t.h = g.h
"""
