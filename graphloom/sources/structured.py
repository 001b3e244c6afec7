"""Places in structured sources: JSON nodes with their pointers, record collections, markdown sections and tables."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.parsing import Limits, xml_problem

#: A tag (start or ``end``), or what only looks like one: comments, instructions, character data, declarations.
XML_TAG = re.compile(r"""<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<![^>]*>|<(?P<end>/?)[^<>"'\s/]+(?:[^<>"']|"[^"]*"|'[^']*')*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=<>"'/]+)\s*=\s*("[^"]*"|'[^']*')""")


class JsonNode(NamedTuple):
    pointer: str
    start: int
    end: int
    kind: str
    parent_is_array: bool


#: How deep JSON may go, and how many collections and records one source may have.
JSON_DEPTH, COLLECTIONS, RECORDS = 64, 16, 2000
_TOKEN = re.compile(r'[\s,:]*("(?:[^"\\]|\\.)*"|[{}\[\]]|[^\s,:{}\[\]"]+)', re.S)
_KINDS = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}


def json_nodes(text: str) -> Iterator[JsonNode]:
    """Every node of a valid JSON text, an element after those that it holds; ValueError for repeated keys or too deep a text.

    Tokens are taken one by one; the open objects and arrays, with what they have had so far, are the only state.
    """
    opened: list[tuple[str, int, bool, set | int]] = []  # pointer, start, is an array, keys or number of elements
    key: str | None = None
    for m in _TOKEN.finditer(text):
        token, start, end = m[1], m.start(1), m.end(1)
        if token in "}]":
            pointer, began, array, _ = opened.pop()
            yield JsonNode(pointer, began, end, "array" if array else "object", bool(opened) and opened[-1][2])
            continue
        if opened and not opened[-1][2] and key is None:
            key = json.loads(token)
            if key in opened[-1][3]:
                raise ValueError("JSON_DUPLICATE_KEY")
            opened[-1][3].add(key)
            continue
        pointer = ""
        if opened:
            above, began, array, n = opened[-1]
            name = str(n) if array else key.replace("~", "~0").replace("/", "~1")
            pointer = f"{above}/{name}"
            if array:
                opened[-1] = (above, began, True, n + 1)
            key = None
        if token in "{[":
            if len(opened) > JSON_DEPTH:
                raise ValueError("JSON_DEPTH_LIMIT")
            opened.append((pointer, start, token == "[", 0 if token == "[" else set()))
        else:
            yield JsonNode(pointer, start, end, _KINDS.get(token[0], "number"), bool(opened) and opened[-1][2])


def locate_json(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, pointer, char_start, char_end, kind) of every node of each JSON text; a text with a fault gives one row of kind 'error'."""

    def locate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for key, text in zip(frame[id_column], frame["text"], strict=True):
                try:
                    json.loads(text)
                    rows += [(key, *node[:4]) for node in json_nodes(text)]
                except (TypeError, ValueError, RecursionError):
                    rows.append((key, None, None, None, "error"))
            yield pd.DataFrame(rows, columns=[id_column, "pointer", "char_start", "char_end", "kind"]).astype({"char_start": "Int32", "char_end": "Int32"})

    return docs.select(id_column, "text").mapInPandas(locate, f"{id_column} long, pointer string, char_start int, char_end int, kind string")


def xml_nodes(text: str) -> Iterator[tuple[str, str, int, int, str | None]]:
    """(path, kind, start, end, value) of every element and attribute of a well-formed XML text.

    A path counts elements of one name among their siblings: /a/b[2]/@c. An element ends after those in it; its value is its text
    if it holds no element. The open elements are the only state.
    """
    opened: list[list] = []  # path, start, end of the start tag, counts of children by name

    def closed(path: str, start: int, inner: int, seen: dict, at: int, end: int) -> tuple[str, str, int, int, str | None]:
        return path, "element", start, end, None if seen else html.unescape(text[inner:at])

    for m in XML_TAG.finditer(text):
        if m["end"] is None:
            continue
        if m["end"]:
            yield closed(*opened.pop(), m.start(), m.end())
            continue
        tag = m[0][1:-1].rstrip("/")
        name = re.match(r"[^\s]+", tag)[0]
        above, counts = ("", {}) if not opened else (opened[-1][0], opened[-1][3])
        counts[name] = counts.get(name, 0) + 1
        path = f"{above}/{name}" + (f"[{counts[name]}]" if opened else "")
        for a in _ATTRIBUTE.finditer(tag, len(name)):
            yield f"{path}/@{a[1]}", "attribute", m.start() + 1 + a.start(2) + 1, m.start() + 1 + a.end(2) - 1, html.unescape(a[2][1:-1])
        if m[0].endswith("/>"):
            yield path, "element", m.start(), m.end(), ""
        else:
            opened.append([path, m.start(), m.end(), {}])


def locate_xml(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, path, kind, char_start, char_end, value) of each element and attribute; a text with a fault gives one row of kind 'error'."""

    def locate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for key, text in zip(frame[id_column], frame["text"], strict=True):
                fault = "none" if text is None else xml_problem(text, Limits())
                rows += [(key, None, "error", None, None, fault)] if fault else [(key, *node) for node in xml_nodes(text)]
            yield pd.DataFrame(rows, columns=[id_column, "path", "kind", "char_start", "char_end", "value"]).astype({"char_start": "Int32", "char_end": "Int32"})

    return docs.select(id_column, "text").mapInPandas(locate, f"{id_column} long, path string, kind string, char_start int, char_end int, value string")


def map_elements(nodes: DataFrame, element: str, fields: dict[str, str], id_column: str = "doc_id") -> DataFrame:
    """(id, record, name, value, char_start, char_end): fields (name -> path below the element) of each element whose path, without its counts, is ``element``.

    A field that an element lacks gives a row without a value. A value is an attribute or the text of an element below.
    """
    plain = F.regexp_replace("path", r"\[\d+\]", "")
    table = nodes.sparkSession.createDataFrame(list(fields.items()), "name string, field string")
    records = nodes.filter((F.col("kind") == "element") & (plain == element)).select(id_column, F.col("path").alias("record"))
    steps = F.split("path", "/")
    depth = element.count("/") + 1
    inside = nodes.withColumn("plain", plain).filter(F.col("plain").startswith(element + "/")).select(
        F.col(id_column).alias("v_id"), F.array_join(F.slice(steps, 1, depth), "/").alias("v_record"), F.substring("plain", len(element) + 2, 1 << 20).alias("v_field"), "value", "char_start", "char_end",
    )
    wanted = records.crossJoin(F.broadcast(table))  # a mapping's fields are few
    return wanted.join(inside, (F.col(id_column) == F.col("v_id")) & (F.col("record") == F.col("v_record")) & (F.col("field") == F.col("v_field")), "left").select(
        id_column, "record", "name", "value", "char_start", "char_end"
    )


def record_collections(nodes: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, collection, record, char_start, char_end, problem): the objects of arrays that hold objects alone and lie in no other array.

    ``nodes`` as ``locate_json`` gives them. A source with too many collections or records gives one row that says so.
    """
    known = nodes.filter("kind <> 'error'").withColumn("parent", F.regexp_replace("pointer", "/[^/]*$", "")).withColumn("is_root", F.col("pointer") == "")
    child = known.filter(~F.col("is_root"))
    arrays = known.filter("kind = 'array'").select(id_column, F.col("pointer").alias("collection"))
    # An array inside an array belongs to the record that holds it: none of the pointers above it may be an array's.
    depth = F.size(F.split("collection", "/"))
    above = arrays.select(id_column, "collection", F.explode(F.transform(F.sequence(F.lit(1), depth - 1), lambda k: F.array_join(F.slice(F.split("collection", "/"), 1, k), "/"))).alias("up"))
    above = above.filter("collection <> ''")
    nested = above.join(arrays.withColumnRenamed("collection", "up"), [id_column, "up"], "left_semi").select(id_column, "collection").distinct()
    held = child.join(arrays.withColumnRenamed("collection", "parent"), [id_column, "parent"], "left_semi")
    whole = held.groupBy(id_column, F.col("parent").alias("collection")).agg(F.bool_and(F.col("kind") == "object").alias("whole")).filter("whole")
    outer = whole.join(nested, [id_column, "collection"], "left_anti").select(id_column, "collection")
    records = held.withColumnRenamed("parent", "collection").join(outer, [id_column, "collection"])
    totals = records.groupBy(id_column).agg(F.count_distinct("collection").alias("n_collections"), F.count(F.lit(1)).alias("n_records"))
    over = totals.filter((F.col("n_collections") > COLLECTIONS) | (F.col("n_records") > RECORDS)).select(id_column)
    place = F.element_at(F.split("pointer", "/"), -1).cast("int")
    fine = records.join(over, id_column, "left_anti").select(id_column, "collection", place.alias("record"), "char_start", "char_end", F.lit(None).cast("string").alias("problem"))
    empty = F.lit(None)
    return fine.unionByName(over.select(
        id_column, empty.cast("string").alias("collection"), empty.cast("int").alias("record"), empty.cast("int").alias("char_start"),
        empty.cast("int").alias("char_end"), F.lit("MAPPING_SOURCE_LIMIT").alias("problem"),
    ))


_FENCE = r"(?P<fence>^ {0,3}(?P<mark>(?P<kind>[`~])(?P=kind){2,}).*$(?:\n.*)*?(?:\n {0,3}(?P=mark)(?P=kind)*[^\S\n]*$|(?P<open>\Z)))"
_LINES = re.compile(_FENCE + r"|(?P<heading>^ {0,3}(?P<level>\#{1,6})[ \t]+(?P<title>.+?)(?:[ \t]+\#+)?[ \t]*$)|(?P<row>^[^\S\n]*\|.*\|[^\S\n]*$)", re.M)
#: A cell runs to the next bar that is neither escaped nor in a code span.
_CELL = re.compile(r"\|(?P<cell>(?:\\.|(?P<tick>`+)(?:.*?[^`])?(?P=tick)(?!`)|[^|\\`])*)(?=\|)")
#: An id of its own is followed by a blank and a title; a title in brackets alone is a title.
_NAMED = re.compile(r"\[(?P<id>[^\]\r\n]{1,256})\]\s+(?P<title>.+)")
_DELIMITER = re.compile(r":?-{3,}:?")


def _cells(text: str, start: int, line: str) -> list[tuple[str, int, int]]:
    found = [(m["cell"], start + m.start("cell")) for m in _CELL.finditer(line)]
    return [(c.strip(), at + len(c) - len(c.lstrip()), at + len(c.rstrip())) if c.strip() else ("", at + len(c), at + len(c)) for c, at in found]


def markdown_records(text: str, level: int) -> tuple[str | None, list[tuple]]:
    """(problem, rows) of one text; rows: (section_id, title, table, record, header, value, start, end), a section's own row without a table."""
    out: list[tuple] = []
    headings: list[tuple[int, str, str]] = []
    tables: list[list] = []  # [section, rows of (cells)], a table for each run of neighbouring rows
    last_end = -2
    for m in _LINES.finditer(text):
        if m["fence"] is not None:
            if m["open"] is not None:
                return "MARKDOWN_FENCE_UNCLOSED", []
        elif m["heading"] is not None:
            if len(m["level"]) == level:
                named = _NAMED.fullmatch(m["title"])
                headings.append((m.start(), *((named["id"], named["title"]) if named else (m["title"], m["title"]))))
            elif headings:
                return "MARKDOWN_UNMAPPED_HEADING_LEVEL", []
        elif headings:
            if m.start() != last_end + 1:
                tables.append([len(headings) - 1, []])
            tables[-1][1].append(_cells(text, m.start(), m[0]))
            last_end = m.end()
    if not headings:
        return "MARKDOWN_SECTION_LIMIT", []
    if len({name for _, name, _ in headings}) < len(headings):
        return "MARKDOWN_DUPLICATE_SECTION", []
    ends = [*(at for at, _, _ in headings[1:]), len(text)]
    out += [(name, title, None, None, None, None, at, end) for (at, name, title), end in zip(headings, ends, strict=True)]
    numbers: dict[int, int] = {}
    for section, rows in tables:
        names = [c for c, _, _ in rows[0]]
        if len(rows) < 2 or len(rows[1]) != len(names) or not all(_DELIMITER.fullmatch(c) for c, _, _ in rows[1]):
            return "MARKDOWN_TABLE_INVALID", []
        if "" in names or len(set(names)) < len(names):
            return "MARKDOWN_TABLE_HEADER", []
        if any(len(r) != len(names) for r in rows):
            return "MARKDOWN_TABLE_WIDTH", []
        number = numbers[section] = numbers.get(section, -1) + 1
        _, name, title = headings[section]
        out += [(name, title, number, k, h, *cell) for k, row in enumerate(rows[2:]) for h, cell in zip(names, row, strict=True)]
    return None, out


def locate_markdown(docs: DataFrame, level: int = 2, id_column: str = "doc_id") -> DataFrame:
    """(id, section_id, title, table, record, header, value, char_start, char_end, problem): sections of one heading level and their tables' cells."""
    names = ["section_id", "title", "table", "record", "header", "value", "char_start", "char_end"]

    def locate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for key, text in zip(frame[id_column], frame["text"], strict=True):
                problem, found = markdown_records(text or "", level)
                rows += [(key, *r, None) for r in found] if problem is None else [(key, *[None] * 8, problem)]
            whole = dict.fromkeys(("table", "record", "char_start", "char_end"), "Int32")
            yield pd.DataFrame(rows, columns=[id_column, *names, "problem"]).astype(whole)

    kinds = "section_id string, title string, table int, record int, header string, value string, char_start int, char_end int, problem string"
    return docs.select(id_column, "text").mapInPandas(locate, f"{id_column} long, {kinds}")
