r"""Operator 4: line dedup by overlapping three-line windows (DataFrame functions only).

Every three consecutive lines of a text are hashed; a window that occurs more than once over all
documents is repeated. Its first occurrence (smallest doc_id, then place) stays; later ones cover their three
lines, and the covered lines of a text, merged, are removed.

Defined results: lines are what stands between line feeds, compared as they are; windows of blank lines alone are not
counted. A text of fewer than three lines is one window of all its lines, so it meets only whole texts of the same
lines; the query's SQL has no such windows, so with ``short`` false those texts stay. A null text stays null with 0 lines. Null ids come
before all others. Rows with the same id and text are one document and fare alike. A text whose
lines are all covered becomes empty, and ``n_removed`` equals ``n_lines``. Other columns are kept as they
are, whatever their names; only columns named n_lines and n_removed, which are results, are replaced. An empty table
gives an empty table. A very long text costs time and memory in proportion to its lines, in one task.

A window that very many documents share is summed map-side, and the join back to its occurrences
may be split by adaptive skew handling. Texts move once, to meet their covered places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

WINDOW = 3


def _key(id_column: str, text_column: str) -> dict[str, Column]:
    return {"gl_id": F.col(id_column), "gl_text": F.xxhash64(F.col(text_column))}


def windows(docs: DataFrame, id_column: str, text_column: str, size: int = WINDOW, short: bool = True) -> DataFrame:
    """(gl_id, gl_text, at, long, h1, h2): the windows of each text, of ``long`` lines, by their 128-bit hash."""
    lines = F.split(F.col(text_column), "\n", -1)
    split = docs.select(*(c.alias(k) for k, c in _key(id_column, text_column).items()), lines.alias("lines")).filter(
        F.size("lines") >= (1 if short else size)
    )
    window = lambda i: F.slice("lines", i + 1, size)
    found = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("lines") - size, F.lit(0))),
        lambda i: F.when(
            F.exists(window(i), lambda x: x.rlike(r"[^\t\r ]")),
            F.struct(
                i.alias("at"), F.least(F.size("lines"), F.lit(size)).alias("long"), F.xxhash64(window(i)).alias("h1"), F.xxhash64(F.lit(1), window(i)).alias("h2")
            ),
        ),
    )
    return split.select("gl_id", "gl_text", F.explode(found).alias("w")).filter("w IS NOT NULL").select(
        "gl_id", "gl_text", "w.*"
    )


def covered_places(found: DataFrame) -> DataFrame:
    """(gl_id, gl_text, covered): the places of lines that later occurrences cover, of each document that has some."""
    place = F.struct("gl_id", "gl_text", "at")
    repeated = (
        found.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter("first <> last").select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first")
    )
    # Joined on less than it is grouped by, so that both sides are dealt anew and a hot window may be split.
    later = found.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") + F.lit(0) == F.col("r2") + F.lit(0))).filter(
        ~place.eqNullSafe(F.col("first"))
    )
    return later.groupBy("gl_id", "gl_text").agg(F.collect_set("at").alias("starts"), F.max("long").alias("long")).select(
        "gl_id", "gl_text",
        F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + F.col("long") - 1)))).alias("covered"),
    )


def drop_repeated_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = WINDOW, short: bool = True
) -> DataFrame:
    """``docs`` with its texts without covered lines, and ``n_lines`` and ``n_removed``."""
    c_id, c_text, covered, lines, fence = common.free_names(docs, "c_id", "c_text", "covered", "lines", "fence")
    found = covered_places(windows(docs, id_column, text_column, size, short)).toDF(c_id, c_text, covered)
    key = _key(id_column, text_column)
    joined = docs.join(found, key["gl_id"].eqNullSafe(F.col(c_id)) & (key["gl_text"] == F.col(c_text)), "left")
    split = F.split(F.col(text_column), "\n", -1)
    # What lies between neighbouring covered places, in time linear in the lines.
    edges = F.concat(F.array(F.lit(-1)), F.array_sort(covered), F.array(F.size(split)))
    between = lambda k: F.slice(lines, F.get(fence, k) + 2, F.get(fence, k + 1) - F.get(fence, k) - 1)
    joined = joined.withColumns({lines: split, fence: edges})
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(fence) - 2), between)), "\n")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed", text_column.lower())]
    return joined.select(
        *others,
        F.when(F.col(covered).isNull(), F.col(text_column)).otherwise(kept).alias(text_column),
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_removed"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs, short=False).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(l) - 2)) AS i, l FROM d WHERE len(l) >= 3),
h AS (SELECT doc_id, i, l[i+1:i+3] AS k FROM w WHERE len(list_filter(l[i+1:i+3], lambda x: regexp_matches(x, '[^\t\r ]'))) > 0),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h),
c AS (SELECT doc_id, list(DISTINCT i + o) AS p FROM f, (VALUES (0), (1), (2)) t(o) WHERE n > 1 GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.l), 0) AS n_lines, coalesce(len(c.p), 0) AS n_removed,
       sha256(CASE WHEN c.p IS NULL THEN d.text ELSE array_to_string(
           [l[j + 1] FOR j IN range(0, len(l)) IF NOT list_contains(c.p, j)], chr(10)) END) AS text_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id
"""
