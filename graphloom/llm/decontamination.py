r"""Operator 5: benchmark decontamination by a distributed positional inverted index.

The index is sharded by documents. A segment is one row: its documents with their places, and for each indexed
term the ascending list of its positions. Segments are stored in the shared folder and searched where they
lie, so postings are never shuffled. Only terms that occur in the test set are indexed (or all, on demand).

A search takes the shortest posting list of each phrase, shifts it to where the phrase would start, and
intersects it with the shifted lists of the next terms, from the rarest to the most frequent, until
all terms agree: an exact phrase match. A proximity search takes the rarest terms of an item, by their postings in the whole
index, and returns the places of the rarest with all of them within a span; terms that no document has are passed over, and an
item of which too few terms are left has no such places. Test sets larger than a block are searched block by
block, and the hits are merged per document.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. Defined results: null texts have no words; an item
without words has no window and one of fewer words than a window is one window. Documents without hits
get n_hit 0, n_items 0 and the digest of an empty list. Items that share an item_id count once, and a null
item_id is left out of the list of items but its windows still hit. Rows that share a doc_id are
judged each on their own. An empty table gives no rows, an empty test set no hits. doc_id is an integer (or null). A very long
text is a segment of its own and costs memory in proportion to its words. Columns are selected by name, and
``clean_documents`` keeps all of them, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

WINDOW = 13
#: UTF-8 bytes of documents in a segment, and of items that one search carries to the executors.
SEGMENT_BYTES = 8_000_000
BLOCK_BYTES = 32_000_000
#: Words within which the query looks for an item's rarest terms, and matches of a segment that are held at once.
NEAR, MATCHES_TOGETHER = 20, 100_000

INDEX_FIELDS = (
    "segment long, doc_ids array<long>, text_keys array<long>, n_words array<int>, terms array<binary>, lens array<int>, gaps array<int>"
)


def build_index(
    docs: DataFrame, terms: set[bytes] | None = None, id_column: str = "doc_id", text_column: str = "text",
    segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """The positional index of ``docs``, a row per segment; ``terms`` limits it to these.

    gaps holds the posting lists one after another, each list's positions as differences.
    Position 0 is the first word of the segment; one position is left free after each document.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(None if terms is None else sorted(terms))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        fixed = broadcast.value is not None
        number = {t: i for i, t in enumerate(broadcast.value or ())}
        for batch in batches:
            names, texts, keys = batch.column(1), batch.column(2), batch.column(3)
            first = batch.column(0)[0].as_py() if batch.num_rows else 0
            for part in common.chunks_by_bytes(common.byte_lengths(texts), segment_bytes):
                if not fixed:
                    number = {}
                found, counts, at = [], [], 0
                for text in texts[part.start : part.stop].to_pylist():
                    words = common.alnum_words(text)
                    if fixed:
                        ids = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
                    else:
                        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
                    found += [ids, np.full(1, -1, np.int32)]
                    counts.append(len(words))
                ids = np.concatenate(found)
                where = np.flatnonzero(ids >= 0)
                order = where[np.argsort(ids[where], kind="stable")]
                terms_here, starts = np.unique(ids[order], return_index=True)
                lens = np.diff(starts, append=len(order))
                gaps = np.diff(order, prepend=0)
                gaps[starts] = order[starts]
                text_of = broadcast.value if fixed else list(number)
                row = [first + part.start, names[part.start : part.stop].to_pylist(), keys[part.start : part.stop].to_pylist(), counts, [text_of[t] for t in terms_here], lens, gaps]
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                    names=["segment", "doc_ids", "text_keys", "n_words", "terms", "lens", "gaps"],
                )

    numbered = docs.select(
        F.monotonically_increasing_id().alias("at"), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column),
        F.xxhash64(F.col(text_column)).alias("text_key"),
    )
    return numbered.mapInArrow(index, INDEX_FIELDS)


class _Postings:
    """A segment's posting lists by term."""

    def __init__(self, row: dict):
        self.n_words = row["n_words"].astype(np.int64)
        self.doc_starts = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        lens = row["lens"].astype(np.int64)
        ends = np.cumsum(lens)
        total = np.cumsum(row["gaps"], dtype=np.int64)
        before = np.where(ends > lens, total[np.maximum(ends - lens - 1, 0)], 0)
        self.positions = total - np.repeat(before, lens)
        self.slot = {t: k for k, t in enumerate(row["terms"])}
        self.starts, self.lens = ends - lens, lens
        self.span = int(self.doc_starts[-1]) + 1
        # Ascending, as lists follow one another: (list, position) as one number.
        self.keys = np.repeat(np.arange(len(lens)), lens) * self.span + self.positions

    def holds(self, slots: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position is in the list of that slot."""
        keys = slots * self.span + positions
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return (self.keys[at] == keys) & (positions >= 0)

    def phrases(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of each occurrence; phrases: rows of slots, -1 where the segment lacks the term."""
        alive = np.flatnonzero((phrases >= 0).all(axis=1))
        if not len(alive) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slots = phrases[alive]
        rarest = np.argsort(self.lens[slots], axis=1, kind="stable")
        head = rarest[:, 0]
        lists = np.take_along_axis(slots, head[:, None], 1)[:, 0]
        many = self.lens[lists]
        row = np.repeat(np.arange(len(alive)), many)
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start = self.positions[self.starts[lists][row] + within] - head[row]
        for k in range(1, slots.shape[1]):
            offset = rarest[row, k]
            same = self.holds(slots[row, offset], start + offset)
            row, start = row[same], start[same]
            if not len(row):
                break
        return alive[row], start

    def near(self, slots: list[int], within: int) -> np.ndarray:
        """Positions of the first of these terms with all others at most ``within`` words away in the same document."""
        if min(slots) < 0:
            return np.zeros(0, np.int64)
        lists = [self.positions[self.starts[s] : self.starts[s] + self.lens[s]] for s in slots]
        at = lists[0]
        doc = np.searchsorted(self.doc_starts, at, "right")
        for other in lists[1:]:
            low = np.searchsorted(other, np.maximum(at - within, self.doc_starts[doc - 1]))
            high = np.searchsorted(other, np.minimum(at + within, self.doc_starts[doc] - 2), "right")
            at, doc = at[high > low], doc[high > low]
        return at


def windows_of(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The windows of an item: ``width`` consecutive words, or all of them if there are fewer."""
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def _blocks(items: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple[str | None, list[bytes]]]]]:
    """How many blocks of about ``block_bytes`` the items make, and the blocks one by one: (item_id, words)."""
    row = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text"))
    size = row.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))

    def block(k: int) -> list[tuple[str | None, list[bytes]]]:
        some = row.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else row
        return [(r["item_id"], common.alnum_words(r["text"])) for r in some.collect()]

    return blocks, map(block, range(blocks))


def rarest_terms(index: DataFrame, items: list[tuple[str | None, list[bytes]]], near_terms: int) -> list[list[bytes]]:
    """Each item's ``near_terms`` terms (or all, if it has fewer) of fewest postings in the whole index, the rarest first."""
    wanted = index.sparkSession.createDataFrame([(t,) for t in sorted({t for _, words in items for t in words})], "term binary")
    counts = index.select(F.explode(F.arrays_zip("terms", "lens")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(
        F.sum("t.lens").alias("n")
    )
    postings = {bytes(r["term"]): r["n"] for r in counts.join(wanted, "term", "left_semi").collect()}  # of a block's terms
    found = []
    for _, words in items:
        terms = set(words)
        have = sorted((postings[t], t) for t in terms if t in postings)[:near_terms]
        found.append([t for _, t in have] if len(have) == min(near_terms, len(terms)) else [])
    return found


def search(index: DataFrame, items: list[tuple[str | None, list[bytes]]], width: int = WINDOW, near: int | None = None, near_terms: int = 3) -> DataFrame:
    """(segment, place, doc_id, item, kind, start, stop): matches in documents, in words from the document's start.

    kind is 'phrase' for windows found word by word, and with ``near`` also 'near' for places where the
    item's ``near_terms`` rarest terms in the whole index stand within that many words of the rarest one. item numbers ``items``.
    """
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for i, (_, words) in enumerate(items):
        for window in windows_of(words, width):
            by_length.setdefault(len(window), {}).setdefault(window, set()).add(i)
    queries = index.sparkSession.sparkContext.broadcast(
        ([(n, list(found), [sorted(s) for s in found.values()]) for n, found in sorted(by_length.items())],
         rarest_terms(index, items, near_terms) if near is not None else [])
    )  # at most a block of items

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        phrase_sets, item_terms = queries.value
        vocabulary = sorted({t for _, phrases, _ in phrase_sets for p in phrases for t in p})
        number = {t: k for k, t in enumerate(vocabulary)}
        coded = [
            (n, np.array([[number[t] for t in p] for p in phrases], np.int64), np.concatenate(owners), np.array([len(o) for o in owners], np.int64))
            for n, phrases, owners in phrase_sets
        ]
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].values for c in ("n_words", "lens", "gaps")}
                row = {c: np.asarray(v) for c, v in row.items()} | {"terms": batch.column("terms")[k].as_py()}
                segment, doc_ids = batch.column("segment")[k].as_py(), batch.column("doc_ids")[k].as_py()
                lists = _Postings(row)
                slots = np.array([lists.slot.get(t, -1) for t in vocabulary], np.int64)
                doc_ids = np.array([0 if d is None else d for d in doc_ids], np.int64), np.array([d is None for d in doc_ids], bool)

                def out(items: np.ndarray, at: np.ndarray, n: int, kind: str) -> Iterator[pa.RecordBatch]:
                    for k in range(0, len(at), MATCHES_TOGETHER):
                        item, here = items[k : k + MATCHES_TOGETHER], at[k : k + MATCHES_TOGETHER]
                        place = np.searchsorted(lists.doc_starts, here, "right") - 1
                        start = here - lists.doc_starts[place]
                        many = len(here)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(many, segment)), pa.array(place.astype(np.int32)), pa.array(doc_ids[0][place], mask=doc_ids[1][place]),
                                pa.array(item.astype(np.int32)), pa.array([kind] * many, pa.string()),
                                pa.array(start.astype(np.int32)), pa.array((start + n).astype(np.int32)),
                            ],
                            names=["segment", "place", "doc_id", "item", "kind", "start", "stop"],
                        )

                for n, phrases, owners, many in coded:
                    which, starts = lists.phrases(slots[phrases])
                    # A window's owners lie one after another; occurrences are repeated for each in bounded parts.
                    first = np.cumsum(many) - many
                    ends = np.cumsum(many[which])
                    a = 0
                    while a < len(which):
                        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MATCHES_TOGETHER, "right")))
                        own = many[which[a:b]]
                        nth = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                        yield from out(owners[np.repeat(first[which[a:b]], own) + nth], np.repeat(starts[a:b], own), n, "phrase")
                        a = b
                for i, terms in enumerate(item_terms):
                    if terms:
                        at = lists.near([lists.slot.get(t, -1) for t in terms], near)
                        yield from out(np.full(len(at), i), at, 1, "near")

    return index.mapInArrow(match, "segment long, place int, doc_id long, item int, kind string, start int, stop int")


def _merged(spans: F.Column) -> F.Column:
    """Words that the spans (start, stop) cover together."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["stop"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["end"], s["start"]))).alias("n"),
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def contamination(
    docs: DataFrame, items: DataFrame, width: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
    block_bytes: int = BLOCK_BYTES, near: int | None = None, near_terms: int = 3, segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """(segment, place, doc_id, text_key, n_words, n_hit, n_items, items_sha256, items, contaminated) of each row.

    With ``near`` also near_items, the items of proximity matches, and n_near, their places; the other columns are of phrases alone.
    """
    many, blocks = _blocks(items, block_bytes)
    hits, terms = None, None  # for a test set of many blocks all terms are indexed, once
    if many == 1:
        (only,) = blocks
        blocks, terms = [only], {t for _, words in only for t in words}
    index = common.stage(build_index(docs, terms, id_column, text_column, segment_bytes), "index")
    phrase = F.col("kind") == "phrase"
    for block in blocks:
        names = index.sparkSession.createDataFrame(
            [(i, name) for i, (name, _) in enumerate(block)], "item int, item_id string"
        )
        found = search(index, block, width, near, near_terms).join(names, "item").groupBy("segment", "place").agg(
            F.collect_set(F.when(phrase, F.struct("start", "stop"))).alias("spans"), F.collect_set(F.when(phrase, F.col("item_id"))).alias("items"),
            *[F.collect_set(F.when(~phrase, c)).alias(k) for k, c in (("near_items", F.col("item_id")), ("near_places", F.col("start"))) if near is not None],
        )
        found = common.stage(found, "hits") if many > 1 else found
        hits = found if hits is None else hits.unionAll(found)
    hits = hits.groupBy("segment", "place").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(k)))).alias(k) for k in ("near_items", "near_places") if near is not None],
    )
    rows = index.select(
        "segment", F.posexplode(F.arrays_zip("doc_ids", "text_keys", "n_words")).alias("place", "d")
    ).select("segment", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.text_keys").alias("text_key"), F.col("d.n_words").cast("long").alias("n_words"))
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    near_found = [] if near is None else [
        F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"), F.coalesce(F.size("near_places"), F.lit(0)).cast("long").alias("n_near"),
    ]
    return (
        rows.join(hits, ["segment", "place"], "left")
        .withColumn("n_hit", F.coalesce(_merged(F.col("spans")), F.lit(0)).cast("long"))
        .select(
            "segment", "place", "doc_id", "text_key", "n_words", "n_hit",
            F.size(items_found).cast("long").alias("n_items"),
            F.sha2(F.array_join(items_found, ",").cast("binary"), 256).alias("items_sha256"),
            items_found.alias("items"),
            ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *near_found,
        )
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones."""
    found = contamination(docs, items, id_column=id_column, text_column=text_column).filter("contaminated")
    x_id, x_key = common.free_names(docs, "x_id", "x_key")
    dropped = common.stage(found.select(F.col("doc_id").alias(x_id), F.col("text_key").alias(x_key)).distinct(), "dropped")
    here = F.col(id_column).eqNullSafe(F.col(x_id)) & (F.xxhash64(F.col(text_column)) == F.col(x_key))
    return docs.join(dropped, here, "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, of exact phrases, and the proximity matches: their items' ids and how many places."""
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), near=NEAR).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "near_items", "n_near"
    )
