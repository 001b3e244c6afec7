"""Full-text index: each text is tokenised once, and a search reads the postings of its own terms."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import store
from graphloom.functions.text import words
from graphloom.staging import shared_root, stage

#: The term under which the index holds the length of every document, empty ones too.
ALL = ""
SCHEMA = "term string, id long, tf long, length int"


#: Words that are counted at once; a longer document is counted by itself.
WORDS_AT_ONCE = 200_000


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of consecutive documents of at most ``WORDS_AT_ONCE`` words."""
    total, start = np.cumsum(lengths), 0
    while start < len(lengths):
        before = int(total[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + WORDS_AT_ONCE, "right")))
        yield start, stop
        start = stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, id, tf, length) of documents (id, bag): slice by slice, so that what is held beside a batch does not grow with its texts."""
    for batch in batches:
        ids, bags = batch.column(0), batch.column(1)
        all_lengths = np.asarray(pc.list_value_length(bags), np.int64)
        for start, stop in _slices(all_lengths):
            lengths, n = all_lengths[start:stop], stop - start
            words_ = pc.dictionary_encode(bags[start:stop].flatten())
            terms = max(1, len(words_.dictionary))
            pairs, tf = np.unique(np.repeat(np.arange(n), lengths) * terms + np.asarray(words_.indices, np.int64), return_counts=True)
            rows = np.concatenate([np.arange(n), pairs // terms])
            found = pa.concat_arrays([pa.array([ALL] * n, words_.dictionary.type), words_.dictionary.take(pa.array(pairs % terms))])
            yield pa.RecordBatch.from_arrays(
                [found, ids[start:stop].take(pa.array(rows)), pa.array(np.concatenate([np.ones(n, np.int64), tf]), pa.int64()), pa.array(lengths[rows], pa.int32())],
                names=["term", "id", "tf", "length"])
        pa.default_memory_pool().release_unused()


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, id, tf, length): how often each term stands in each document of ``length`` words; one row under ``ALL`` for each document.

    A null or empty text has no words and its row under ``ALL``. Ids are taken as they are: rows that share one count as several documents.
    """
    bags = docs.select(F.col(key).alias("id"), F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("bag"))
    return bags.mapInArrow(_counted, f"term string, id {dict(bags.dtypes)['id']}, tf long, length int")


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """The postings as Parquet in ranges of (term, id): a term's row groups are found by their statistics, a frequent term has many files."""
    # Staged, since the ranges are found in one pass and filled in another.
    stage(postings(docs, key, text), "postings").repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.option(
        "parquet.block.size", 16 << 20
    ).parquet(path)


def index_of(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text", root: str | None = None) -> DataFrame:
    """The index of the stored table ``docs``, called ``name``, as the table is now; written where no application has yet written it.

    It lies under ``root`` (the shared folder), by the version of the table's files, and stays there; an index is seen once it is
    written whole. ``drop_indexes`` removes those of earlier versions.
    """
    spark: SparkSession = docs.sparkSession
    at = _folder(spark, name, key, text, root)
    pointer = f"{at}/{store.table_version(docs)}.at"
    path = store.read_text(spark, pointer)
    if path is None:
        own = f"{at}/{uuid.uuid4().hex}"
        write_index(docs, own, key, text)
        if not store.publish_new(spark, pointer, own):
            store.remove(spark, own)  # another application was first
        path = store.read_text(spark, pointer)
    return spark.read.schema(SCHEMA).parquet(path)


def drop_indexes(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text", root: str | None = None) -> int:
    """Remove the indexes of the table's earlier versions, and what writers have left that failed; how many versions went.

    For times without readers or writers of these.
    """
    spark = docs.sparkSession
    at, now = _folder(spark, name, key, text, root), f"{store.table_version(docs)}.at"
    kept = store.read_text(spark, f"{at}/{now}") or ""
    gone = 0
    for found in store.names_in(spark, at):
        if found != now and found != kept.rsplit("/", 1)[-1]:
            store.remove(spark, f"{at}/{found}")
            gone += found.endswith(".at")
    return gone


def _folder(spark: SparkSession, name: str, key: str, text: str, root: str | None) -> str:
    mark = hashlib.sha256("\0".join((name, key, text)).encode()).hexdigest()[:24]
    return f"{(root or shared_root(spark)).rstrip('/')}/graphloom-fulltext/{mark}"


def bm25(index: DataFrame, terms: list[str], floor: float | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): BM25 of the terms; document frequencies and lengths are those of all documents of the index."""
    found = index.filter(F.col("term").isin(ALL, *terms))
    stats = found.filter(F.col("term") == ALL).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    hits = found.filter(F.col("term") != ALL)
    frequency = hits.groupBy(F.col("term").alias("f_term")).agg(F.count(F.lit(1)).alias("df"))
    # One row of totals, and one for each term.
    totals = frequency.crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = hits.join(F.broadcast(totals), F.col("term") == F.col("f_term")).groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored if floor is None else scored.filter(F.col("score") >= floor)
