r"""Operator 12: spelling variants by letter-parity bitmask bands (DataFrame functions only).

A word's mask says of each letter whether it occurs an odd number of times. An inserted or deleted character flips one bit, a
replaced one two at most, so of three bands of the mask at least one stays equal. Words are joined on an equal band, with lengths
that differ by one at most, and verified by their edit distance. Few masks are common to very many words, so a band's words
are split further by a half of the word: one edit leaves the first or the last half of the shorter word's length as it is. A
pair that meets by several bands or halves counts by its first.

A word's form is its most frequent near word, if that is ``ratio`` times as frequent; forms lead from word to word, each at least
``ratio`` times as frequent as the one before, so a root is at most log(largest count) steps away and is found by doubling the steps.

Defined results: a null or empty text has no words. A null id is taken as an empty one. Repeated rows count each time.
Ties between near words go to the smaller word in code-point order. Columns are selected by name, so others may have any names. An
empty table gives no rows. A very long text's words are cut in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

BANDS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = 5, least_count: int = 3, drop_every: int | None = 97
) -> DataFrame:
    r"""(word, n): runs ``[A-Za-zÀ-ÿ]+`` with A-Z lower-cased, of ``least_chars`` characters, that occur ``least_count`` times.

    Where ``drop_every`` divides the crc32 of ``<id>:<run>``, the run loses its character at crc32 mod its length (misspelling made to order).
    """
    number = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    runs = docs.select(number.alias("number"), F.explode(F.split(F.col(text_column), r"[^A-Za-zÀ-ÿ]+")).alias("run"))
    # lower() changes A-Z alone in ASCII; in other runs letters such as É must stay.
    lower = F.when(F.length("run") == F.octet_length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    words = runs.filter(F.length("run") >= least_chars).select("number", lower.alias("word"))
    if drop_every:
        h = F.crc32(F.concat_ws(":", "number", "word").cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        short = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2, F.length("word")))
        words = words.withColumn("h", h).select(F.when(F.col("h") % drop_every == 0, short).otherwise(F.col("word")).alias("word"))
        words = words.filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def band_masks(word: Column) -> list[Column]:
    """The three bands of the word's letter parities: of a to z each letter, of others their code modulo 64, has a bit of its own."""
    code = lambda c: F.when((F.ascii(c) >= 97) & (F.ascii(c) <= 122), F.ascii(c) - 97).otherwise(26 + F.ascii(c) % 64)
    codes = F.transform(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)), code)

    def band(b: int) -> Column:
        own = F.filter(codes, lambda c: c % BANDS == b)
        bits = F.transform(own, lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (c / BANDS).cast("int")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda seen, bit: seen.bitwiseXOR(bit))

    return [band(b) for b in range(BANDS)]


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words of which one inserted, deleted or replaced character makes the other, once."""
    masked = words.select("word", "n", F.length("word").alias("chars"), F.array(*band_masks(F.col("word"))).alias("bands"))

    def keyed(shorter: Column, tag: str) -> DataFrame:
        """Rows by (band, its value, the shorter word's length, side, half), for pairs whose shorter word has that length."""
        half = F.floor(F.col("shorter") / 2).cast("int")
        rest = F.col("shorter") - half
        sides = F.array(
            F.struct(F.lit(0).alias("side"), F.substr("word", F.lit(1), half).alias("half")),
            F.struct(F.lit(1).alias("side"), F.substr("word", F.col("chars") - rest + 1, rest).alias("half")),
        )
        rows = masked.withColumn("shorter", F.explode(shorter)).withColumn("s", F.explode(sides))
        rows = rows.select("word", "n", "chars", "bands", "shorter", "s", F.posexplode("bands").alias("band", "value"))
        return rows.select(
            F.struct("band", "value", "shorter", "s.side", "s.half").alias(f"{tag}_key"),
            F.col("word").alias(tag), F.col("n").alias(f"n_{tag}"), F.col("chars").alias(f"chars_{tag}"), F.col("bands").alias(f"bands_{tag}"),
            *([F.col("band"), F.col("s.side").alias("side"), F.col("s.half").alias("half")] if tag == "a" else []),
        )

    one = keyed(F.array("chars"), "a")
    other = keyed(F.array(F.col("chars"), F.col("chars") - 1), "b")
    equal = [F.col("bands_a")[k] == F.col("bands_b")[k] for k in range(BANDS)]
    first_band = F.when(equal[0], 0).when(equal[1], 1).otherwise(2)
    first_side = F.when(F.substr("a", F.lit(1), F.floor(F.col("chars_a") / 2).cast("int")) == F.substr("b", F.lit(1), F.floor(F.col("chars_a") / 2).cast("int")), 0).otherwise(1)
    order = (F.col("chars_a") < F.col("chars_b")) | (F.col("a") < F.col("b"))
    met_first = (F.col("band") == first_band) & (F.col("side") == first_side)
    near = F.levenshtein("a", "b", 1) == 1
    return one.join(other, (F.col("a_key") == F.col("b_key")) & order & met_first & near).select("a", "n_a", "b", "n_b")


def spelling_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word; ``words`` (word, n) is read several times: a stored table."""
    pairs = near_pairs(words)
    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("p"))
    # The most frequent first, of those the smallest word.
    best = each.groupBy(F.col("p.word").alias("p_word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("p.near_n")).alias("minus"), F.col("p.near").alias("near"))).alias("best"))
    found = words.join(best, F.col("word") == F.col("p_word"), "left")
    leads = -F.col("best.minus") >= ratio * F.col("n")
    found = common.stage(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.minus")).alias("form_n"),
    ), "spelling-forms")
    links = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    least, most = found.agg(F.min("n"), F.max("n")).first()
    steps = math.log(most / least, ratio) if most else 0
    for _ in range(math.ceil(math.log2(steps + 1)) if steps > 1 else 0):
        on = links.select(F.col("word").alias("o_word"), F.col("root").alias("o_root"))
        links = common.stage(links.join(on, F.col("root") == F.col("o_word"), "left").select("word", F.coalesce("o_root", "root").alias("root")), "spelling-roots")
    roots = links.select(F.col("word").alias("r_word"), "root")
    return found.join(roots, F.col("word") == F.col("r_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(common.table(spark, sf_dir, "documents"))
    return spelling_groups(common.stage(words, "spelling-words"))


#: crc32 is computed from its polynomial (0xEDB88320); near words share a text that is left when one character goes.
OP12_SQL = r"""
WITH RECURSIVE bits(i, c, k) AS (SELECT i, CAST(i AS BIGINT), 0 FROM range(0, 256) t(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
r AS (SELECT CAST(doc_id AS VARCHAR) AS d,
  translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
s AS (SELECT d, w, count(*) AS n FROM r WHERE length(w) >= 5 GROUP BY d, w),
b AS (SELECT w, n, flatten(list_transform(range(1, length(d || ':' || w) + 1), lambda i: CASE WHEN unicode((d || ':' || w)[i]) < 128
  THEN [CAST(unicode((d || ':' || w)[i]) AS BIGINT)] ELSE [192 + (unicode((d || ':' || w)[i]) >> 6), 128 + (unicode((d || ':' || w)[i]) & 63)] END)) AS y FROM s),
h AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), y), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, tab),
x AS (SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM x WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
g AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
o AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM g),
e AS (SELECT a.word, b.word AS near, b.n AS near_n FROM o a JOIN o b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM v a JOIN o b ON a.word = b.rest UNION SELECT b.word, a.word, a.n FROM v a JOIN o b ON a.word = b.rest),
f AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM e GROUP BY word),
z AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN f ON v.word = f.word),
q(word, root, k) AS (SELECT word, word, 0 FROM z UNION ALL SELECT q.word, z.form, k + 1 FROM q JOIN z ON q.root = z.word WHERE z.form IS NOT NULL)
SELECT z.word, form, root, n, n_near, form_n FROM z JOIN (SELECT word, arg_max(root, k) AS root FROM q GROUP BY word) USING (word)
"""
