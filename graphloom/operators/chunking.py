"""Gapless chunking: the chunks of a text, joined, are the text. Offsets count code points."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.structured import XML_TAG, json_nodes

#: Delimiters after which a chunk may end, best first.
DELIMITERS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")


def split_fixed(docs: DataFrame, most: int = 1200, id_column: str = "doc_id") -> DataFrame:
    """Slices of ``most`` characters: (id, ordinal, char_start, char_end, chunk)."""
    size = F.length("text")
    return docs.filter(size > 0).select(
        id_column, "text", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / most).cast("int"))).alias("ordinal")
    ).select(
        id_column, "ordinal", (F.col("ordinal") * most).alias("char_start"),
        F.least((F.col("ordinal") + 1) * most, size).alias("char_end"),
        F.expr(f"substring(text, ordinal * {most} + 1, {most})").alias("chunk"),
    )


def cut_points(text: str, most: int, ratio: float) -> list[int]:
    """Ends of the chunks: behind the last of the best delimiters in the last part of each window."""
    ends, start = [], 0
    while len(text) - start > most:
        low, high = start + math.ceil(most * ratio), start + most
        found = ((text.rfind(d, low, high), len(d)) for d in DELIMITERS)
        end = next((at + n for at, n in found if at >= 0), high)
        ends.append(end)
        start = end
    return [*ends, len(text)] if text else []


@dataclass(frozen=True)
class ChunkingOptions:
    """How a source is cut; the bounds are fixed by the sources' contract."""

    max_chars: int = 1200
    strategy: str = "structure"

    def __post_init__(self) -> None:
        if self.strategy not in ("structure", "fixed", "mapped_document"):
            raise ValueError("unknown chunking strategy")
        most = 65_536 if self.strategy == "mapped_document" else 3000
        if type(self.max_chars) is not int or not 800 <= self.max_chars <= most:
            raise ValueError(f"max_chars must be an integer from 800 to {most}")

    @property
    def signature(self) -> str:
        return f"upload-chunking:v1:strategy={self.strategy}:max={self.max_chars}"


def chunks_of(docs: DataFrame, cut: Callable[[str], Iterable[tuple[int, int, str | None]]], id_column: str = "doc_id") -> DataFrame:
    """(id, ordinal, char_start, char_end, label, chunk): the (start, end, label) that ``cut`` gives for each text."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (key, ordinal, start, end, label, text[start:end])
                for key, text in zip(frame[id_column], frame["text"], strict=True)
                for ordinal, (start, end, label) in enumerate(cut(text or ""))
            ]
            yield pd.DataFrame(rows, columns=[id_column, "ordinal", "char_start", "char_end", "label", "chunk"])

    return docs.select(id_column, "text").mapInPandas(
        split, f"{id_column} long, ordinal int, char_start int, char_end int, label string, chunk string"
    )


def split_boundary(docs: DataFrame, most: int = 1200, ratio: float = 0.6, id_column: str = "doc_id") -> DataFrame:
    """Chunks of at most ``most`` characters that end at delimiters: (id, ordinal, char_start, char_end, chunk)."""

    return chunks_of(docs, lambda text: _spans(cut_points(text, most, ratio)), id_column).drop("label")


def packed(text: str, places: Iterable[int], most: int, ratio: float) -> list[int]:
    """Ends of chunks that go to the last of ``places`` within reach; where none is, as ``cut_points`` cuts."""
    stops, ends, start = sorted({0, *places, len(text)}), [], 0
    while start < len(text):
        last = stops[bisect_right(stops, start + most) - 1]
        if last <= start:
            last = start + cut_points(text[start : start + most + 1], most, ratio)[0]
        ends.append(last)
        start = last
    return ends


def json_places(text: str) -> set[int]:
    """Where records begin and end: the elements of a root array, the values of a root object and the elements of its arrays."""
    found: set[int] = set()
    for node in json_nodes(text):
        keys = node.pointer.count("/")
        if keys == 1 or (keys == 2 and node.parent_is_array):
            found |= {node.start, node.end}
    return found


def xml_places(text: str) -> set[int]:
    """Where elements begin and end, and where their start tags end."""
    tags = [m for m in XML_TAG.finditer(text) if m["end"] is not None]
    return {m.end() for m in tags} | {m.start() for m in tags if not m["end"]}


def split_json(docs: DataFrame, most: int = 1200, ratio: float = 0.6, id_column: str = "doc_id") -> DataFrame:
    """JSON texts in chunks of whole records: (id, ordinal, char_start, char_end, label, chunk)."""
    return chunks_of(docs, lambda text: _spans(packed(text, json_places(text), most, ratio)), id_column)


def split_xml(docs: DataFrame, most: int = 1200, ratio: float = 0.6, id_column: str = "doc_id") -> DataFrame:
    """XML texts in chunks that end at tags."""
    return chunks_of(docs, lambda text: _spans(packed(text, xml_places(text), most, ratio)), id_column)


def _spans(ends: list[int]) -> Iterator[tuple[int, int, None]]:
    return ((a, b, None) for a, b in zip([0, *ends], ends, strict=False))


#: Fenced code (to its closing fence, or to the end), a pipe table (a row, a delimiter row, more rows), a blank line, a heading.
_BLOCKS = re.compile(
    r"(?P<fence>^ {0,3}(?P<mark>(?P<kind>[`~])(?P=kind){2,})(?:(?<=`)[^`\n]*|(?<=~).*)$(?:\n.*)*?(?:\n {0,3}(?P=mark)(?P=kind)*[^\S\n]*$(?P<closed>\n?)|\Z))"
    r"|(?P<table>^.*\|.*\n[^\S\n]*\|*[^\S\n]*:?-+:?[^\S\n]*(?:\|[^\S\n]*:?-+:?[^\S\n]*)*\|*[^\S\n]*$(?:\n(?=.*\S).*\|.*)*\n?)"
    r"|(?P<blank>^[^\S\n]*\n)"
    r"|(?P<heading>^ {0,3}(?P<level>\#{1,6})(?:[ \t]+(?P<title>.*?)|[ \t]*)(?:[ \t]+\#+)?[ \t]*$)",
    re.M,
)


def markdown_layout(text: str) -> tuple[list[tuple[int, str | None]], set[int]]:
    """The sections (start, heading path), and where blocks begin and end."""
    path: dict[int, str] = {}
    sections: list[tuple[int, str | None]] = [(0, None)]
    places: set[int] = set()
    for m in _BLOCKS.finditer(text):
        if m["heading"] is not None:
            if title := (m["title"] or "").strip():
                path = {k: v for k, v in path.items() if k < len(m["level"])} | {len(m["level"]): title}
                here = (m.start(), " / ".join(path.values()))
                sections = [here] if m.start() == 0 else [*sections, here]
        elif m["blank"] is not None:
            places.add(m.end())
        else:
            places.add(m.start())
            if m["table"] is not None or m["closed"] is not None:
                places.add(m.end())
    return sections, places


def split_markdown_sections(docs: DataFrame, most: int = 1200, ratio: float = 0.6, id_column: str = "doc_id") -> DataFrame:
    """Each headed section cut as ``split_boundary`` does: (id, ordinal, char_start, char_end, label, chunk)."""

    def cut(text: str) -> Iterator[tuple[int, int, str | None]]:
        sections, _ = markdown_layout(text)
        for (start, label), (end, _) in zip(sections, [*sections[1:], (len(text), None)], strict=True):
            ends = cut_points(text[start:end], most, ratio)
            yield from ((start + a, start + b, label) for a, b in zip([0, *ends], ends, strict=False))

    return chunks_of(docs, cut, id_column)


def split_markdown_packed(docs: DataFrame, most: int = 1200, ratio: float = 0.6, id_column: str = "doc_id") -> DataFrame:
    """Short sections packed together, long ones cut between paragraphs, tables and fences; the label names the first and last."""

    def cut(text: str) -> Iterator[tuple[int, int, str | None]]:
        sections, blocks = markdown_layout(text)
        starts = [s for s, _ in sections]
        inner = sorted(blocks)
        places = set(starts)
        for start, end in zip(starts, [*starts[1:], len(text)], strict=True):
            if end - start > most:
                places.update(inner[bisect_right(inner, start) : bisect_left(inner, end)])
        ends = packed(text, places, most, ratio)
        for start, end in zip([0, *ends], ends, strict=False):
            first, last = sections[bisect_right(starts, start) - 1][1], sections[bisect_left(starts, end) - 1][1]
            yield start, end, f"{first} → {last}" if first and last and first != last else first or last

    return chunks_of(docs, cut, id_column)


def split_pages(pages: DataFrame, most: int = 1200, fixed: bool = False, id_column: str = "doc_id") -> DataFrame:
    """Chunks inside each page (id, page_number, text), counted and placed over the whole source.

    (id, ordinal, char_start, char_end, page_number, section, chunk). A source's pages are joined without anything between them.
    """
    keyed = pages.select(id_column, "page_number", "text").filter(F.length("text") > 0)
    in_page = Window.partitionBy(id_column).orderBy("page_number")
    whole = keyed.select(id_column, "page_number", (F.sum(F.length("text")).over(in_page) - F.length("text")).alias("page_start"))
    # A page's own key, so that pages are cut apart wherever they lie.
    row = keyed.select(F.xxhash64(id_column, "page_number").alias("page_key"), "text")
    cut = split_fixed(row, most, "page_key") if fixed else split_boundary(row, most, id_column="page_key")
    placed = cut.join(whole.withColumn("page_key", F.xxhash64(id_column, "page_number")), "page_key")
    order = Window.partitionBy(id_column).orderBy("page_number", "ordinal")
    return placed.select(
        id_column, (F.row_number().over(order) - 1).alias("ordinal"), (F.col("page_start") + F.col("char_start")).cast("int").alias("char_start"),
        (F.col("page_start") + F.col("char_end")).cast("int").alias("char_end"), "page_number",
        F.concat(F.lit("PDF physical page "), F.col("page_number").cast("string")).alias("section"), "chunk",
    )


def gapless_report(chunks: DataFrame, docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, n_chunks, gapless): ordinals 0.., neighbours touch, slices equal the text, and the whole is covered."""
    order = Window.partitionBy(id_column).orderBy("ordinal")
    joined = chunks.join(docs.select(id_column, "text"), id_column).select(
        id_column, "ordinal", "char_start", "char_end",
        (F.col("chunk") == F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).alias("same"),
        F.length("text").alias("size"),
    )
    seen = joined.select(
        id_column, "ordinal", "char_end", "size", "same",
        (F.coalesce(F.lag("char_end").over(order), F.lit(0)) == F.col("char_start")).alias("touches"),
        (F.row_number().over(order) - 1 == F.col("ordinal")).alias("counted"),
    )
    return seen.groupBy(id_column).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        (F.bool_and(F.col("same") & F.col("touches") & F.col("counted")) & (F.max("char_end") == F.max("size"))).alias("gapless"),
    )
