"""Bounded reading of uploaded sources: media type, UTF-8, newlines, JSON and CSV limits, checksums."""

from __future__ import annotations

import csv
import io
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import jsontext


@dataclass(frozen=True)
class Limits:
    """Bounds of one source; the values are fixed by the sources' contract."""

    source_bytes: int = 5 << 20
    chars: int = 5 << 20
    json_depth: int = 64
    json_nodes: int = 100_000
    csv_rows: int = 100_000
    csv_cells: int = 1_000_000
    csv_field: int = 100_000
    xml_depth: int = 64
    xml_nodes: int = 100_000


#: Media types that are read as text, as JSON, as CSV and as XML.
TEXT_TYPES, JSON_TYPE, CSV_TYPE, XML_TYPES = ("text/plain", "text/markdown"), "application/json", "text/csv", ("application/xml", "text/xml")


def media_type(declared: Column) -> Column:
    """The media type in lower case, or null if a parameter other than a UTF-8 charset is declared."""
    parameters = F.filter(F.slice(F.split(declared, ";"), 2, 1 << 20), lambda p: F.trim(p) != "")
    fine = F.forall(parameters, lambda p: p.rlike(r'(?i)^\s*charset\s*=\s*"?utf-?8"?\s*$'))
    return F.when(fine, F.lower(F.trim(F.split_part(declared, F.lit(";"), F.lit(1)))))


def json_problem(text: str, limits: Limits) -> str | None:
    """What is wrong with a JSON text: syntax, repeated keys, constants that JSON has not, nodes or depth."""
    try:
        level = [jsontext.strict(text)]
    except ValueError as fault:
        return str(fault) if str(fault).startswith("JSON_") else "JSON_INVALID"
    depth = nodes = 0
    while level:  # level by level, so the depth is the number of turns
        depth, nodes = depth + 1, nodes + len(level)
        if nodes > limits.json_nodes:
            return "JSON_NODE_LIMIT"
        if depth > limits.json_depth:
            return "JSON_DEPTH_LIMIT"
        level = [c for x in level if isinstance(x, (dict, list)) for c in (x.values() if isinstance(x, dict) else x)]
    return None


def csv_problem(text: str, limits: Limits) -> str | None:
    """What is wrong with a CSV text: its form, or the first of its bounds that a row passes."""
    bounds = {"CSV_ROW_LIMIT": limits.csv_rows, "CSV_CELL_LIMIT": limits.csv_cells, "CSV_FIELD_LIMIT": limits.csv_field}
    cells = 0
    try:
        for n, row in enumerate(csv.reader(io.StringIO(text, newline=""), strict=True), 1):
            cells += len(row)
            reached = (n, cells, max(map(len, row), default=0))
            over = [code for (code, bound), now in zip(bounds.items(), reached, strict=True) if now > bound]
            if over:
                return over[0]
    except csv.Error:
        return "CSV_INVALID"
    return None


def xml_problem(text: str, limits: Limits) -> str | None:
    """What is wrong with an XML text: form, a document type, nodes or depth."""
    parser, at = expat.ParserCreate(), [0, 0, None]

    def opened(name: str, attributes: dict) -> None:
        at[0], at[1] = at[0] + 1, at[1] + 1
        at[2] = at[2] or ("XML_NODE_LIMIT" if at[1] > limits.xml_nodes else "XML_DEPTH_LIMIT" if at[0] > limits.xml_depth else None)

    def closed(name: str) -> None:
        at[0] -= 1

    def typed(*declaration) -> None:  # noqa: ANN002
        at[2] = at[2] or "XML_DOCTYPE"

    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = opened, closed, typed
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError:
        return at[2] or "XML_INVALID"
    return at[2]


def parse_sources(sources: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``sources`` (payload, mime_type and any others) with media, original_checksum, text, checksum and problem.

    The text is UTF-8 without a byte order mark, with line feeds for newlines, in normal form C; a source with a problem
    has none. Checks on bytes and characters are expressions; only JSON, CSV and texts beyond ASCII reach Python.
    """
    raw = F.col("payload")
    sized = sources.withColumn("media", media_type(F.col("mime_type"))).withColumn("original_checksum", F.sha2(raw, 256))
    size = F.octet_length(raw)
    early = (
        F.when(F.coalesce(size, F.lit(0)) == 0, "EMPTY").when(size > limits.source_bytes, "BYTE_LIMIT")
        .when(F.col("media").isNull(), "CHARSET_UNSUPPORTED").when(~F.col("media").isin(*TEXT_TYPES, JSON_TYPE, CSV_TYPE, *XML_TYPES), "MEDIA_UNSUPPORTED")
        .when(~F.is_valid_utf8(raw.cast("string")), "UTF8_INVALID")
    )
    decoded = F.regexp_replace(raw.cast("string"), "^﻿", "")
    checked = sized.withColumn("problem", early).withColumn("text", F.when(F.col("problem").isNull(), decoded))

    checks = {JSON_TYPE: json_problem, CSV_TYPE: csv_problem} | dict.fromkeys(XML_TYPES, xml_problem)

    @F.pandas_udf("problem string, text string")
    def by_format(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for media, texts in parts:
            rows = []
            for kind, text in zip(media, texts, strict=True):
                rows.append((checks[kind](text, limits) if text is not None and kind in checks else None, text and unicodedata.normalize("NFC", text)))
            yield pd.DataFrame(rows, columns=["problem", "text"])

    lines = F.regexp_replace("text", "\r\n?", "\n")
    python = F.col("text").isNotNull() & (F.col("media").isin(*checks) | F.col("text").rlike(r"[^\x00-\x7f]"))
    # A format is checked on the decoded text as it came, newlines too.
    formed = checked.withColumn("by", F.when(python, by_format(F.when(python, F.col("media")), F.when(python, F.col("text")))))
    problem = F.coalesce("problem", "by.problem")
    text = F.regexp_replace(F.coalesce("by.text", "text"), "\r\n?", "\n")
    late = (
        F.when(problem.isNotNull(), problem).when(~lines.rlike(r"(?U)\S"), "BLANK")
        .when(lines.rlike(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"), "CONTROL_CHARACTER").when(F.length(text) > limits.chars, "CHARACTER_LIMIT")
    )
    done = formed.withColumn("found", late).withColumn("whole", F.when(F.col("found").isNull(), text))
    others = [c for c in sources.columns if c not in ("payload", "mime_type")]
    return done.select(*others, "media", "original_checksum", F.col("whole").alias("text"), F.sha2(F.col("whole").cast("binary"), 256).alias("checksum"), F.col("found").alias("problem"))
