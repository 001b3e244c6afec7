"""Operator 7: best-fit packing with large-item matching.

Documents are encoded where they lie, an end id is appended, and only those longer than a sequence
are cut. The packing is decided on the histogram of piece lengths, which has at most one row per
length up to the capacity however large the corpus is: pieces above a third of the capacity pair
at most twice per sequence, each largest one with the largest that still fits; smaller ones, in
descending order, go to the fullest sequence that still takes them. Sequences filled alike are
handled as one range, so the plan is a list of ranges (this many pieces of this length go to these
sequences at this place). Spark then numbers the pieces of each length and looks their place up.

Defined results: a null or empty text is the end id alone. Pieces of equal length are interchangeable,
so ties and repeated rows only decide which of them goes where. An empty table gives an empty result. doc_id is an integer (or
null). A very long text's ids are held whole in one task. Columns are selected by name, so others may have any names.
Numbering is dealt by (length, salt), so a length that a third of all pieces share is spread.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.llm.pieces import worker_encoder

BATCH_BYTES = 4_000_000
#: Rows of the plan that one lookup carries; a longer plan is split by length and looked up in turns.
PLAN_ROWS = 200_000
#: Pieces that one number range (length, salt) is meant to hold.
NUMBERED_TOGETHER = 100_000


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first, last, sequence, per_sequence, offset) for a histogram of lengths.

    Pieces first..last-1 of that length: number ``first + k`` goes to sequence ``sequence + k // per_sequence``,
    at ``offset + k % per_sequence * length``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    given = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    spare: dict[int, list[tuple[int, int]]] = {}  # free space -> ranges (first sequence, how many)
    spaces: list[int] = []  # the keys of spare, ascending
    sequences = 0

    def put(n: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        plan.append((n, given[n], given[n] + pieces, sequence, each, offset))
        given[n] += pieces
        left[n] -= pieces

    def keep(space: int, sequence: int, many: int) -> None:
        if many and space:
            if space not in spare:
                spare[space] = []
                insort(spaces, space)
            spare[space].append((sequence, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large.pop()
        while left[a]:
            at = bisect_left(large, capacity - a + 1) - 1
            if 2 * a <= capacity and left[a] > 1:
                b, pairs = a, left[a] // 2
            elif at >= 0:
                b, pairs = large[at], min(left[a], left[large[at]])
            else:
                b, pairs = 0, left[a]
            put(a, pairs, sequences, 1, 0)
            if b:
                put(b, pairs, sequences, 1, a)
                if b != a and not left[b]:
                    large.remove(b)
            keep(capacity - a - b, sequences, pairs)
            sequences += pairs
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(spaces, n)
            if at == len(spaces):
                new = -(-left[n] // (capacity // n))
                keep(capacity, sequences, new)
                sequences += new
                continue
            space = spaces[at]
            sequence, many = spare[space].pop()
            if not spare[space]:
                del spare[space]
                spaces.pop(at)
            each = space // n
            full = min(many, left[n] // each)
            if full:
                put(n, full * each, sequence, each, capacity - space)
                keep(space - each * n, sequence, full)
            else:  # the last pieces of this length fill one sequence in part
                full, rest = 1, left[n]
                put(n, rest, sequence, rest, capacity - space)
                keep(space - rest * n, sequence, 1)
            keep(space, sequence + full, many - full)
    return np.array(sorted(plan), np.int64).reshape(-1, 6)


def cut_documents(
    docs: DataFrame, vocabulary: str, capacity: int, end_id: int, spaced: bool = False, id_column: str = "doc_id",
    text_column: str = "text", batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of each document."""
    end = np.array([end_id], "<u4").tobytes()
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary, spaced)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = common.byte_lengths(texts)
            for part in common.chunks_by_bytes(sizes, batch_bytes):
                ids, counts = encoder.ids([t or "" for t in texts[part.start : part.stop].to_pylist()])
                raw, at, rows = memoryview(ids.astype("<u4").tobytes()), 0, []
                for name, n in zip(names[part], counts.tolist(), strict=True):
                    for piece, start in enumerate(range(0, n + 1, capacity)):
                        stop = min(start + capacity, n + 1)
                        crc = zlib.crc32(raw[(at + start) * 4 : (at + min(stop, n)) * 4])
                        rows.append((name, piece, start, stop - start, zlib.crc32(end, crc) if stop > n else crc))
                    at += n
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column)).mapInArrow(cut, fields)


def numbered(pieces: DataFrame, total: int) -> DataFrame:
    """``pieces`` with ``number``: 0, 1, ... within each length, by counts of (length, salt)."""
    salts = min(max(64, total // NUMBERED_TOGETHER), 1 << 16)
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = (
        dealt.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
        .select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), "before")
    )
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    own = dealt.withColumn("own", F.row_number().over(order) - 1)
    return own.join(before, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt"))).withColumn(
        "number", F.col("own") + F.col("before")
    )


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (as ``cut_documents`` gives them, staged) with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    rows = numbered(pieces, sum(counts.values())).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "number"
    )
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def placed(plan: np.ndarray):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.trim()
            shift = np.int64(1) << 48
            keys = plan[:, 0] * shift + plan[:, 1]
            for batch in batches:
                n, number = (np.asarray(batch.column(c)) for c in ("length", "number"))
                row = plan[np.searchsorted(keys, n * shift + number, "right") - 1]
                k = number - row[:, 1]
                columns = [
                    *batch.columns[:5], pa.array(row[:, 3] + k // row[:, 4]), pa.array(row[:, 5] + k % row[:, 4] * n)
                ]
                names = [*batch.schema.names[:5], "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return place

    if len(plan) <= PLAN_ROWS:
        return rows.mapInArrow(placed(plan), fields)
    # Whole lengths in turns, each with a bounded part of the plan.
    out, first = None, 0
    while first < len(plan):
        last = int(np.searchsorted(plan[:, 0], plan[min(first + PLAN_ROWS, len(plan)) - 1, 0], "right"))
        part = plan[first:last]
        some = rows.filter(F.col("length").between(int(part[0, 0]), int(part[-1, 0]))).mapInArrow(placed(part), fields)
        out, first = some if out is None else out.unionAll(some), last
    return out


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, spaced: bool = False
) -> DataFrame:
    """Where each piece of each document goes: sequences of at most ``capacity`` ids."""
    return pack(common.stage(cut_documents(docs, vocabulary, capacity, end_id, spaced), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
