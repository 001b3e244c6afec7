"""Operator 10: a token store of directly addressable codes.

An id is split into 8-bit chunks. The lowest chunks of all ids make level 1; a bitmap marks the ids that
continue, and their next chunks make level 2, and so on. Rank directories count the bits before
each block of the bitmaps, so the chunks of any one token are found by position alone: nothing before
it is decoded. A file holds consecutive documents, with their ids and starts, and ends in a mark.

Encoding happens where the texts lie; ids (at the width the vocabulary needs) are then dealt by ranges of
doc_id and sorted within them, and each range is written as one or more files by Spark's own
writer, with its commit protocol. The bounds of the ranges are quantiles of doc_id alone.

Reading goes through the addresses: runs of documents are decoded from the places that rank gives for the first of
each, level by level, so neither what precedes a run nor the rest of the file is decoded with it.

Defined results: null doc_ids come first, then ascending order; rows that share a doc_id are ordered by
their ids. A null or empty text is the end id alone. An empty table gives no files and no rows. doc_id is an integer (or null).
A very long text's ids are held whole in one task, and rows that share a doc_id (or have none) are written by one task. Columns are selected by name, so others may have any names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.llm.pieces import worker_encoder

MAGIC = b"GLDAC\x01"
END = "GLDACEND"
BLOCK = 512  # bits between entries of a rank directory
DOCS_PER_RANGE = 2048
MOST_RANGES = 20_000
#: A range is continued in another file beyond so many ids; a document is never split.
IDS_PER_FILE = 16_000_000
#: Ranges that one task writes; so the tasks grow with the documents.
RANGES_PER_TASK = 4
#: Ids that one read of a run of documents decodes.
IDS_PER_RUN = 65_536
BATCH_BYTES = 4_000_000
_HEAD = struct.Struct("<6sHqqQQ")  # magic, levels, range, part, documents, ids


def encode_levels(ids: np.ndarray) -> bytes:
    """The levels of the codes: for each its length, chunks, continuation bitmap and rank directory."""
    out, rest = [], ids.astype(np.uint64)
    while True:
        more = rest >= 256
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
        out += [struct.pack("<Q", len(rest)), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        if not more.any():
            return b"".join(out)
        rest = rest[more] >> 8


def encode_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, range_no: int, part: int) -> bytes:
    levels = encode_levels(ids)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype("<u8")
    head = _HEAD.pack(MAGIC, BLOCK, range_no, part, len(doc_ids), len(ids))
    return head + names.tobytes() + known.tobytes() + starts.tobytes() + levels


class TokenFile:
    """Random access to a file's ids."""

    def __init__(self, content: bytes):
        if not content.endswith(END.encode()):
            raise ValueError("the file is cut short")
        magic, self.block, self.range_no, self.part, n, self.n_ids = _HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at, last = _HEAD.size, len(content) - len(END)
        self.names = np.frombuffer(content, "<i8", n, at)
        self.known = np.frombuffer(content, np.uint8, n, at + 8 * n)
        self.starts = np.frombuffer(content, "<u8", n + 1, at + 9 * n).astype(np.int64)
        at += 9 * n + 8 * (n + 1)
        self.levels = []
        while at < last:
            (size,) = struct.unpack_from("<Q", content, at)
            chunks = np.frombuffer(content, np.uint8, size, at + 8)
            bits = np.frombuffer(content, np.uint8, -(-size // 8), at + 8 + size)
            ranks = np.frombuffer(content, "<u8", -(-size // self.block) + 1, at + 8 + size + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + size + len(bits) + 8 * len(ranks)

    def doc_id(self, k: int) -> int | None:
        return int(self.names[k]) if self.known[k] else None

    def rank(self, level: int, i: int) -> int:
        """Set bits before place i of a level's bitmap: one entry of the directory and part of one block."""
        _, bits, ranks = self.levels[level]
        block = i // self.block
        first = block * self.block
        part = np.unpackbits(bits[first // 8 : -(-i // 8)], count=i - first, bitorder="little") if i > first else bits[:0]
        return int(ranks[block]) + int(part.sum())

    def token(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i = self.rank(level, i)
        raise ValueError("a code runs past the last level")

    def tokens(self, first: int, stop: int) -> np.ndarray:
        """The ids at places first..stop-1; a level's places are found by rank of the first alone."""
        out = np.zeros(stop - first, np.uint32)
        where = None
        for level, (chunks, bits, _) in enumerate(self.levels):
            part = chunks[first:stop].astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out |= part
            else:
                out[where] |= part
            byte = first // 8
            more = np.unpackbits(bits[byte : -(-stop // 8)], bitorder="little")[first - 8 * byte :][: stop - first].astype(bool)
            n = int(more.sum())
            if not n:
                break
            where = np.flatnonzero(more) if where is None else where[more]
            first = self.rank(level, first)
            stop = first + n
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))

    def runs(self, most: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, stop, ids) of runs of documents of at most ``most`` ids (a longer document is a run), each read by its address."""
        first, n = 0, len(self.names)
        while first < n:
            stop = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + most, "right")) - 1)
            yield first, stop, self.tokens(int(self.starts[first]), int(self.starts[stop]))
            first = stop


def range_bounds(docs: DataFrame, id_column: str, per_range: int = DOCS_PER_RANGE) -> list[int]:
    """Ascending bounds of doc_id ranges of about ``per_range`` rows; only the id column is read."""
    n = docs.select(F.count(id_column)).first()[0]
    ranges = min(MOST_RANGES, -(-n // per_range))
    if ranges < 2:
        return []
    at = [k / ranges for k in range(1, ranges)]
    return sorted({int(b) for b in docs.select(F.col(id_column).cast("double").alias("d")).approxQuantile("d", at, 0.25 / ranges)})


def write_store(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, spaced: bool = False, id_column: str = "doc_id",
    text_column: str = "text", per_range: int = DOCS_PER_RANGE, ids_per_file: int = IDS_PER_FILE,
) -> None:
    """Encode ``docs`` and write their ids under ``path``, in ascending order of their ids."""
    bounds = np.array(range_bounds(docs, id_column, per_range), np.int64)
    width = "<u2" if _vocabulary_size(vocabulary) <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary, spaced)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            sizes = common.byte_lengths(texts)
            ranges = np.searchsorted(bounds, np.asarray(names.fill_null(-(1 << 63))), "right")
            for part in common.chunks_by_bytes(sizes, BATCH_BYTES):
                ids, counts = encoder.ids([t or "" for t in texts[part.start : part.stop].to_pylist()])
                ends = np.cumsum(counts)
                whole = np.insert(ids, ends, end_id).astype(width)
                raw, stops = whole.tobytes(), (ends + np.arange(1, len(ends) + 1)) * whole.itemsize
                rows = [raw[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ranges[part], pa.int64()), names[part.start : part.stop], pa.array(rows, pa.binary())],
                    names=["range_no", "doc_id", "ids"],
                )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        now, part, names, parts, total = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), width)
            made = encode_file(names, [len(p) // ids.itemsize for p in parts], ids, now, part)
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["content"])

        for batch in batches:
            for range_no, name, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if names and (range_no != now or total >= ids_per_file):
                    yield flush()
                    part, names, parts, total = part + 1 if range_no == now else 0, [], [], 0
                now = range_no
                names.append(name)
                parts.append(ids)
                total += len(ids) // np.dtype(width).itemsize
        if names:
            yield flush()

    encoded = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column)).mapInArrow(
        encode, "range_no long, doc_id long, ids binary"
    )
    files = encoded.repartition(max(1, (len(bounds) + 1) // RANGES_PER_TASK), "range_no").sortWithinPartitions("range_no", "doc_id", "ids").mapInArrow(build, "content binary")
    # The bytes pass the text writer as they are; a record per file, the line separator is the end mark.
    files.select(F.col("content").cast("string").alias("value")).write.option("lineSep", END).option(
        "maxRecordsPerFile", 1
    ).text(path)


def _vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(range_no, part, doc_id, local_start, n_tokens, ids_crc32, place) of each document in the files."""
    fields = "range_no long, part long, place long, doc_id long, local_start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        for batch in batches:
            for content in batch.column(0):
                f = TokenFile(content.as_py())
                for first, stop, ids in f.runs(IDS_PER_RUN):
                    raw, ends = memoryview(ids.astype("<u4").tobytes()), ((f.starts[first : stop + 1] - f.starts[first]) * 4).tolist()
                    crcs = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    n = stop - first
                    columns = [
                        np.full(n, f.range_no), np.full(n, f.part), np.arange(first, stop),
                        pa.array(f.names[first:stop], mask=f.known[first:stop] == 0), f.starts[first:stop], np.diff(f.starts[first : stop + 1]), crcs,
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns],
                        names=["range_no", "part", "place", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                    )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, fields)


def store_and_read(docs: DataFrame, vocabulary: str, end_id: int, spaced: bool = False) -> DataFrame:
    """Write the store in the shared folder, read it back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = common.staging_path(spark, "tokens")
    write_store(docs, path, vocabulary, end_id, spaced)
    found = common.stage(read_store(spark, path), "token-rows")
    # One row per file: a running sum over the files, not over the documents.
    order = Window.orderBy("range_no", "part")
    files = found.groupBy("range_no", "part").agg(F.sum("n_tokens").alias("n"))
    before = files.select("range_no", "part", (F.sum("n").over(order) - F.col("n")).alias("before"))
    return found.join(before, ["range_no", "part"]).select(
        "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
