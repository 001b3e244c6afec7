r"""Operator 11: fill-in-the-middle transformation by escaped marker injection (DataFrame functions only).

Units are ``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+`` from left to right. A delimiter that cannot occur in the text any
more (its occurrences are escaped first) is put behind every unit; their number is the number of units, and ``substring_index``
takes the parts between ranked delimiters, which are freed of delimiters and escapes and put together again with markers. The two
cuts and the form come from the hash of ``<seed>:<id>``, so a document fares alike in every run and at any partitioning.

Defined results: a null or empty text has no units, is plain and gives an empty output. A text that holds one of the markers is
plain. A null id is hashed as an empty one. Rows with one id are cut alike; repeated rows are all kept. Columns named n, form,
prefix_chars, middle_chars and output, which are results, are replaced; all others are kept, whatever their names. An
empty table gives no rows. A very long text is worked through in one task, in time and memory linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Neither is white space, so escaping moves no border of a unit.
DELIMITER, ESCAPE = "\x01", "\x02"
MARKERS = ("<P>", "<S>", "<M>")
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def escaped(text: Column) -> Column:
    """The text without the delimiter: it and the escape stand as two characters each."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(DELIMITER), F.lit(ESCAPE + "a"))


def plain_part(part: Column) -> Column:
    """A part of a marked text as it was: delimiters go, escapes are undone."""
    without = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(without, F.lit(ESCAPE + "a"), F.lit(DELIMITER)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))


def part(text: Column, by: str, count: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(by), count.cast("int"))


def check_markers(markers: tuple[str, str, str]) -> None:
    """Markers must be told apart wherever they stand: none may hold another's beginning at its end, or another whole."""
    if len(set(markers)) != 3 or not all(markers):
        raise ValueError(f"three different markers are needed, not {markers}")
    for a in markers:
        for b in markers:
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b)) if k < len(a)):
                raise ValueError(f"the markers {a!r} and {b!r} may overlap")


def fill_in_middle(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output."""
    check_markers(markers)
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS]
    names = ("whole", "h", "mark", "units", "kind", "lo", "hi", "head", "mid", "tail")
    whole, h, mark, units, kind, lo, hi, head, mid, tail = common.free_names(docs, *names)
    text = F.coalesce(F.col(text_column), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"), 256)
    group = lambda k: F.conv(F.substring(h, 8 * k - 7, 8), 16, 10).cast("long")
    holds = F.lit(False)
    for m in markers:
        holds |= F.col(whole).contains(m)
    found = docs.select(*others, text.alias(whole), digest.alias(h)).withColumn(mark, escaped(F.col(whole)))
    # The delimiter is one byte, so the bytes that are added count the units.
    marked = F.regexp_replace(mark, UNIT, "$0" + DELIMITER)
    found = found.withColumn(units, F.octet_length(mark)).withColumn(mark, marked).withColumns({
        units: (F.octet_length(mark) - F.col(units)).cast("long"),
        kind: F.when((F.col(whole) == "") | holds | (group(3) % 100 >= percent), "plain").when(group(4) % 100 < spm_percent, "spm").otherwise("psm"),
    })
    cuts = [group(k) % (F.col(units) + 1) for k in (1, 2)]
    found = found.withColumns({lo: F.least(*cuts), hi: F.greatest(*cuts)})
    changed = F.col(kind) != "plain"
    upto = part(F.col(mark), DELIMITER, F.col(hi))
    found = found.withColumns({
        head: F.when(changed, plain_part(part(F.col(mark), DELIMITER, F.col(lo)))),
        mid: F.when(changed, F.when(F.col(lo) == F.col(hi), "").otherwise(plain_part(part(upto, DELIMITER, F.col(lo) - F.col(hi))))),
        # Behind the last unit stands a delimiter, so an empty part more is counted from the end.
        tail: F.when(changed, plain_part(part(F.col(mark), DELIMITER, F.col(hi) - F.col(units) - 1))),
    })
    p, s, m = (F.lit(x) for x in markers)
    output = (
        F.when(F.col(kind) == "psm", F.concat(p, head, s, tail, m, mid)).when(F.col(kind) == "spm", F.concat(s, tail, p, head, m, mid))
        .otherwise(F.col(whole))
    )
    return found.select(
        *others, F.col(units).alias("n"), F.col(kind).alias("form"), F.length(head).cast("long").alias("prefix_chars"),
        F.length(mid).cast("long").alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``fill_in_middle`` made this output of, from the output and its form alone."""
    p, s, m = markers
    one, last = F.lit(1), F.lit(-1)

    def joined(first: str, second: str, prefix_leads: bool) -> Column:
        body = F.substring(output, len(first) + 1, 2**31 - 1)
        a, rest = part(body, second, one), part(body, second, last)
        b, middle = part(rest, m, one), part(rest, m, last)
        return F.concat(a, middle, b) if prefix_leads else F.concat(b, middle, a)

    return F.when(form == "psm", joined(p, s, True)).when(form == "spm", joined(s, p, False)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS l,
  [CAST('0x' || h[8 * k + 1:8 * k + 8] AS BIGINT) FOR k IN range(0, 4)] AS g FROM d),
c AS (SELECT doc_id, t, l, len(l) AS n, least(g[1] % (len(l) + 1), g[2] % (len(l) + 1)) AS lo, greatest(g[1] % (len(l) + 1), g[2] % (len(l) + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 50 THEN 'plain'
    WHEN g[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(l[1:lo], '') AS a, array_to_string(l[lo + 1:hi], '') AS b, array_to_string(l[hi + 1:n], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(a || b || z) AS restored_sha256
FROM p
"""
