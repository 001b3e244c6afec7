r"""Operator 3: n-gram Jaccard join by a grouped prefix join.

A document's set holds its distinct 5-word shingles. Two documents link when 100 * |A n B| >= 80 * |A u B|.

1. Documents with equal sets are one class (equal texts need no pairs).
2. Document frequencies of all shingles are counted in hashed key ranges. The most frequent ones, a
   table of bounded size, order the shingles: rare ones first by hash, then frequent ones by frequency. Any
   order gives the same links; this one keeps common passages out of the prefixes.
3. Classes with the same prefix (the first n - ceil(0.8 n) + 1 shingles) and the same size are one group.
   Groups that share a prefix shingle are paired if their sizes and the shingle's places allow a link.
4. Pairs are expanded to classes and verified on the whole sets, computed anew from the texts.
5. A shingle shared by very many groups is first joined as a star around pivots. Lists that are not in one
   component after that are paired in full, in pairs of blocks of bounded size whose sets are intersected
   inside the task; of the links between components, only as many leave it as connect its sets. So no
   component is missed, and a large group is not expanded into all pairs.

Words are ``[^\x20\x09-\x0D]+`` after lower-casing A-Z. Shingles are compared by 64-bit hashes.
Defined results: a document of fewer than five words has its whole sequence as its one shingle; one
without words (or null) has an empty set and links with nothing. Rows that share an id are told apart by
their sets. A null id gets the component of its set, or null if it is alone. An empty table gives no rows. doc_id is an integer
(or null). A very long text's set is held whole in one task. Columns are selected by name, and ``one_of_each`` keeps all
of them, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

WIDTH = 5
#: Most shingles in the frequency table that the executors get, and the least frequency of one in it.
FREQUENT, LEAST_FREQUENT = 500_000, 16
#: A shingle of more groups is joined as stars first; blocks of the full pairing hold about so many groups and shingles.
STAR_ABOVE, BLOCK, BLOCK_SHINGLES = 64, 1024, 1_000_000
BATCH_BYTES = 16_000_000
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], memo: common.HashMemo, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for text in texts:
        words = common.white_words(text)
        h = memo.hashes(words)
        n = len(h)
        if n == 0:
            out.append(h)
            continue
        m, k = (n - width + 1, width) if n >= width else (1, n)
        acc = h[:m].copy()
        for i in range(1, k):
            acc = acc * _STEP + h[i : i + m]
        out.append(np.unique(_mixed(acc + np.uint64(k))))
    return out


def _fingerprint(values: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(values.tobytes(), seed) - (1 << 63)


def _sets(batch: pa.RecordBatch, memo: common.HashMemo, width: int, column: int = 1) -> Iterator[tuple[slice, list[np.ndarray]]]:
    texts = batch.column(column)
    sizes = common.byte_lengths(texts)
    for part in common.chunks_by_bytes(sizes, BATCH_BYTES):
        yield part, shingle_sets(texts[part.start : part.stop].to_pylist(), memo, width)


def _narrow(values: np.ndarray) -> bytes:
    """The values (uint64) in as few bytes each as the largest needs; the first byte tells how many."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _widen(raw: bytes) -> np.ndarray:
    width = raw[0]
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").ravel()


class Order:
    """The global order of shingles: rare ones by hash, then the frequent ones by (frequency, hash)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int):
        by = np.argsort(keys)
        self.keys, self.counts, self.shift = keys[by], counts[by], np.uint64(64 - bits)

    def prefix(self, values: np.ndarray, length: int) -> np.ndarray:
        if not len(self.keys):
            return values[:length]
        at = np.minimum(np.searchsorted(self.keys, values >> self.shift), len(self.keys) - 1)
        frequent = self.keys[at] == values >> self.shift
        rare = values[~frequent]
        if len(rare) >= length:
            return rare[:length]
        common_ones = values[frequent]
        by = np.lexsort((common_ones, self.counts[at[frequent]]))
        return np.concatenate([rare, common_ones[by][: length - len(rare)]])


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def shingle_order(docs: DataFrame, text_column: str, width: int, most: int = FREQUENT, least: int = LEAST_FREQUENT) -> Order:
    """Document frequencies of all shingles; the most frequent ones as an ``Order``."""
    rows = docs.count()
    ranges = min(max(32, rows // 4096), 1 << 31)
    bits = min(64, max(32, math.ceil(math.log2(max(rows, 1) * 512)) + 5))
    memo = common.lazily(common.HashMemo)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        shift, top = np.uint64(64 - bits), np.uint64(bits - 32)
        for batch in batches:
            for _, sets in _sets(batch, memo(), width, 0):
                keys, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]) >> shift, return_counts=True)
                range_no = (keys >> top) * np.uint64(ranges) >> np.uint64(32)
                cuts = [*np.flatnonzero(np.diff(range_no, prepend=range_no[:1] + np.uint64(1))).tolist(), len(keys)]
                found = [(int(range_no[a]), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r for r, _, _ in found], pa.int32()),
                        pa.array([_narrow(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in found], pa.binary()),
                        pa.array([_narrow(counts[a:b].astype(np.uint64)) for _, a, b in found], pa.binary()),
                    ],
                    names=["range_no", "keys", "counts"],
                )

    def total(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(_widen(k), dtype=np.uint64) for k in table["keys"].to_pylist()])
        counts = np.concatenate([_widen(c) for c in table["counts"].to_pylist()])
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
        sums = np.add.reduceat(counts, starts).astype(np.int64)
        often = sums >= least
        return pa.table({"key": keys[starts][often].view(np.int64), "n": sums[often]})

    counted = docs.select(text_column).mapInArrow(count, "range_no int, keys binary, counts binary")
    frequent = common.stage(counted.groupBy("range_no").applyInArrow(total, "key long, n long"), "frequent")
    # The least frequency that keeps the table within its bound, from a histogram.
    level = F.floor(F.log2("n") * 4).cast("int")
    levels = sorted(((r[0], r[1]) for r in frequent.groupBy(level.alias("l")).count().collect()), reverse=True)
    kept, floor = 0, None
    for at, n in levels:
        if kept + n > most:
            break
        kept, floor = kept + n, at
    if floor is None:
        return Order(np.zeros(0, np.uint64), np.zeros(0, np.int64), bits)
    table = frequent.filter(level >= floor).toArrow()
    return Order(np.asarray(table["key"]).view(np.uint64), np.asarray(table["n"]), bits)


def document_sets(docs: DataFrame, order: Order, id_column: str, text_column: str, width: int) -> DataFrame:
    """(doc_id, text_key, n, class, grp, prefix) of each document: fingerprints of its set and of (prefix, size)."""
    memo = common.lazily(common.HashMemo)
    shared = docs.sparkSession.sparkContext.broadcast(order)  # at most FREQUENT entries of 16 bytes

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        for batch in batches:
            for part, sets in _sets(batch, memo(), width):
                prefixes = [shared.value.prefix(s, prefix_length(len(s))) if len(s) else s for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, part.stop - part.start),
                        batch.column(2).slice(part.start, part.stop - part.start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_fingerprint(s) for s in sets], pa.int64()),
                        pa.array([_fingerprint(p, len(s)) for p, s in zip(prefixes, sets, strict=True)], pa.int64()),
                        pa.array([p.astype("<u8").tobytes() for p in prefixes], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n", "class", "grp", "prefix"],
                )

    text = F.col(text_column)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text, F.xxhash64(text).alias("text_key")).mapInArrow(
        describe, "doc_id long, text_key long, n long, class long, grp long, prefix binary"
    )


def _allowed(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes whose first common shingle is at these places can link."""
    reach = 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
    return (9 * reach >= 4 * (na + nb)) & (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb))


def list_pairs(groups: DataFrame) -> DataFrame:
    """Pairs of groups that share a prefix shingle (``b`` set), and the members of long lists (``b`` null)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                lists = [np.frombuffer(p, "<i8") for p in part.column("prefix").to_pylist()]
                lens = np.array([len(x) for x in lists])
                if not lens.sum():
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(lists)),
                        pa.array(np.repeat(np.asarray(part.column("grp")), lens)),
                        pa.array(np.repeat(np.asarray(part.column("n")), lens)),
                        pa.array(np.concatenate([np.arange(n) for n in lens])),
                    ],
                    names=["token", "grp", "n", "place"],
                )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        names = ["token", "a", "b", "n"]

        def out(*columns) -> pa.RecordBatch:  # noqa: ANN002
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

        rest = [np.zeros(0, np.int64)] * 4  # the rows of the last list, which the next batch may continue
        long_token, pivot = None, None

        def long_list(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal pivot
            token, g, n, _ = rows
            pivots = np.zeros(len(g), np.int64)
            for k in range(len(g)):
                if pivot is None or 4 * n[k] > 5 * pivot[1]:
                    pivot = (g[k], n[k])
                pivots[k] = pivot[0]
            star = pivots != g
            yield out(token, g, pa.nulls(len(g), pa.int64()), n)
            yield out(*(x[star] for x in (token, np.minimum(g, pivots), np.maximum(g, pivots), n)))

        def short_lists(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            token, g, n, place = rows
            found = []
            for k in range(1, STAR_ABOVE):
                i = np.flatnonzero(token[:-k] == token[k:])
                if not len(i):
                    break
                i = i[_allowed(n[i], place[i], n[i + k], place[i + k]) & (g[i] != g[i + k])]
                found.append(np.stack([np.minimum(g[i], g[i + k]), np.maximum(g[i], g[i + k])]))
            if found and (pairs := np.unique(np.concatenate(found, axis=1), axis=1)).size:
                none = pa.nulls(pairs.shape[1], pa.int64())
                yield out(none, pairs[0], pairs[1], none)

        def done(rows: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest, long_token, pivot
            token = rows[0]
            if not len(token):
                return
            starts = np.flatnonzero(np.diff(token, prepend=token[:1] - 1))
            sizes = np.diff(starts, append=len(token))
            short = np.ones(len(token), bool)
            for s, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                goes_on = token[s] == long_token
                if goes_on or size > STAR_ABOVE:
                    if not goes_on:
                        long_token, pivot = token[s], None
                    yield from long_list([x[s : s + size] for x in rows])
                    short[s : s + size] = False
            tail = slice(len(token), None)
            if not last and short[-1]:
                tail = slice(int(starts[-1]), None)
                short[tail] = False
            rest = [x[tail] for x in rows]
            yield from short_lists([x[short] for x in rows])

        for batch in batches:
            yield from done([np.concatenate([r, np.asarray(c)]) for r, c in zip(rest, batch.columns, strict=True)], False)
        yield from done(rest, True)

    entries = groups.mapInArrow(spread, "token long, grp long, n long, place long")
    return entries.repartition("token").sortWithinPartitions("token", "n", "grp").mapInArrow(
        pair, "token long, a long, b long, n long"
    )


def open_lists(members: DataFrame, spans: DataFrame) -> DataFrame:
    """(token, grp, blocks): the members (token, a) of lists that hold more than one component; blocks by their classes and shingles."""
    known = members.join(spans, F.col("a") == F.col("grp")).select("token", "grp", "n", "lo", "hi", "size")
    still = known.groupBy(F.col("token").alias("o_token")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.greatest(F.ceil(F.sum("size") / BLOCK), F.ceil(F.sum(F.col("n") * F.col("size")) / BLOCK_SHINGLES)).cast("int").alias("blocks"),
    ).filter("lo <> hi").select("o_token", "blocks")
    return known.join(still, F.col("token") == F.col("o_token")).select("token", "grp", "blocks")


def class_sets(wanted: DataFrame, docs: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """(class, set) of the classes (class, rep) from their documents' whole texts."""
    memo = common.lazily(common.HashMemo)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        for batch in batches:
            for _, sets in _sets(batch, memo(), width, 0):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_fingerprint(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                    names=["class", "set"],
                )

    some = docs.join(wanted.select(F.col("rep").alias("w_rep")).distinct(), F.col(id_column) == F.col("w_rep"), "left_semi")
    found = some.select(text_column).mapInArrow(describe, "class long, set binary")
    return found.join(wanted.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"])


def full_links(members: DataFrame) -> DataFrame:
    """(a, b, common, together): links between components among the members (token, class, label, set, blocks) of lists.

    Each list is cut into blocks, and each pair of blocks is one bounded task, which intersects all its sets at once.
    Of a task's links, those are returned that its components need to hang together: fewer than it has sets.
    """
    dealt = members.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    keyed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "class", "label", "set", "own"
    )

    def link(table: pa.Table) -> pa.Table:
        name, label, own = (np.asarray(table[c]) for c in ("class", "label", "own"))
        sets = [np.frombuffer(x, "<u8") for x in table["set"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        by = np.argsort(values, kind="stable")
        values, row = values[by], row[by]
        column = np.cumsum(np.diff(values, prepend=values[:1]) != 0)
        shared = np.bincount(column) > 1
        keep = shared[column]
        column, row = (np.cumsum(shared) - 1)[column[keep]], row[keep]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for start in range(0, int(shared.sum()), 2048):
            a, b = np.searchsorted(column, [start, start + 2048])
            part = np.zeros((len(sets), 2048), np.float32)
            part[row[a:b], column[a:b] - start] = 1
            both += part @ part.T
        total = sizes[:, None] + sizes[None, :] - both
        linked = (100 * both >= 80 * total) & (label[:, None] != label[None, :])
        if table["i"][0].as_py() != table["j"][0].as_py():
            linked &= own[:, None] != own[None, :]
        unseen, tree = np.ones(len(sets), bool), [np.zeros((2, 0), np.int64)]
        for root in range(len(sets)):
            stack = [root] if unseen[root] else []
            unseen[root] = False
            while stack:
                here = stack.pop()
                new = np.flatnonzero(linked[here] & unseen)
                tree.append(np.stack([np.full(len(new), here), new]))
                unseen[new] = False
                same = np.flatnonzero((label == label[here]) & unseen)
                unseen[same] = False
                stack += [*new.tolist(), *same.tolist()]
        x, y = np.concatenate(tree, axis=1)
        return pa.table({
            "a": np.minimum(name[x], name[y]), "b": np.maximum(name[x], name[y]),
            "common": both[x, y].astype(np.int64), "together": total[x, y].astype(np.int64),
        })

    return keyed.groupBy("token", "i", "j").applyInArrow(link, "a long, b long, common long, together long")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """(a, b, common, together, linked) of ``pairs`` (a, b: classes), by their whole sets."""
    ids = classes.select("class", "rep")
    pairs = pairs.join(ids.toDF("a", "a_id"), "a").join(ids.toDF("b", "b_id"), "b")
    needed = pairs.select(F.explode(F.array("a_id", "b_id")).alias("need")).distinct()
    texts = docs.select(F.col(id_column).cast("long").alias("need"), F.col(text_column).alias("text")).join(needed, "need", "left_semi")
    both = (
        pairs.join(texts.toDF("b_id", "b_text"), "b_id").select("a", "b", "a_id", "b_text")
        .join(texts.toDF("a_id", "a_text"), "a_id").select("a", "b", "a_text", "b_text")
    )
    memo = common.lazily(common.HashMemo)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        last, left, left_class = None, None, None
        for batch in batches:
            rows = []
            for a, b, a_text, b_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a_text is not last:
                    if a_text != last:
                        (left,) = shingle_sets([a_text], memo(), width)
                        left_class = _fingerprint(left)
                    last = a_text
                (right,) = shingle_sets([b_text], memo(), width)
                if left_class != a or _fingerprint(right) != b:
                    continue  # another row with the same id
                both = len(left) + len(right) - len(np.union1d(left, right))
                rows.append((a, b, both, len(left) + len(right) - both))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "common", "together"])

    return both.mapInArrow(verify, "a long, b long, common long, together long").withColumn(
        "linked", 100 * F.col("common") >= 80 * F.col("together")
    )


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest node reachable from each node of ``edges`` (a, b).

    Each node takes its smallest neighbour's own choice if that is smaller; then edges are drawn between what has been
    chosen, and those inside one choice go. So the edges that are left shrink from round to round.
    """
    undirected = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = common.stage(edges.select(*undirected("a", "b")).filter("a <> b").distinct(), "edges")
    found = None
    while found is None or left.limit(1).count():
        ways = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ways.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low")).select("v", F.least("v", "low").alias("low"))
        low = common.stage(low, "lowest")
        chosen = common.stage(low.join(low.toDF("low", "label"), "low").select("v", "label"), "labels")
        drawn = left.join(chosen.toDF("a", "x"), "a").join(chosen.toDF("b", "y"), "b").select(*undirected("x", "y"))
        left = common.stage(drawn.filter("a <> b").distinct(), "edges")
        found = chosen if found is None else common.stage(
            found.join(chosen.toDF("label", "far"), "label", "left").select("v", F.coalesce("far", "label").alias("label")), "labels"
        )
    return found


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links).

    members: (doc_id, text_key, n_shingles, class, component_id), a row per document. classes: (class, grp, n, rep).
    links: (a, b, common, together): the verified links between classes that its components rest on.
    """
    order = shingle_order(docs, text_column, width)
    sets = common.stage(document_sets(docs, order, id_column, text_column, width), "sets")
    filled = sets.filter("n > 0")
    classes = common.stage(
        filled.groupBy("grp", "class").agg(F.min("n").alias("n"), F.min("doc_id").alias("rep")), "classes"
    )
    by_group = classes.groupBy("grp").agg(F.min("class").alias("first"), F.count(F.lit(1)).alias("size"))
    groups = filled.groupBy("grp").agg(F.first("prefix").alias("prefix"), F.min("n").alias("n"))
    lists = common.stage(list_pairs(groups), "lists")
    near = common.stage(lists.filter("b IS NOT NULL").select("a", "b").distinct(), "pairs")
    many = common.stage(by_group, "groups")

    # Stars: first class against first class of paired groups, and each class against the first of its group.
    first = many.select("grp", "first")
    outer = near.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select("x", "y")
    inner = classes.join(many.filter("size > 1").select("grp", "first"), "grp").select("first", "class").filter("first <> class")
    pairs = outer.unionAll(inner).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    check = lambda p: common.stage(verified(p, classes, docs, id_column, text_column, width), "checked")
    checked = check(pairs)
    labels = components(checked.filter("linked"))

    def spans_of(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The component of each class, and the least and greatest component of each group."""
        label = classes.join(labels, F.col("class") == F.col("v"), "left").select(
            "grp", "class", "n", F.coalesce("label", "class").alias("label")
        )
        by_grp = label.groupBy("grp").agg(
            F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"), F.min("n").alias("n")
        )
        return label, common.stage(by_grp, "spans")

    def paired_in_full(members: DataFrame, label: DataFrame, spans: DataFrame) -> DataFrame | None:
        """The links that the lists (token, a) still need, or None if each is in one component."""
        still = common.stage(open_lists(members, spans), "open-lists")
        if not still.limit(1).count():
            return None
        wanted = classes.join(still.select("grp").distinct(), "grp", "left_semi").select("class", "rep")
        sets_of = common.stage(class_sets(wanted, docs, id_column, text_column, width), "class-sets")
        own = still.join(label, "grp").join(sets_of, "class").select("token", "class", "label", "set", "blocks")
        return common.stage(full_links(own).distinct().withColumn("linked", F.lit(True)), "checked")

    # What the stars leave open: long lists, and groups of several classes, that are not in one component.
    label, spans = spans_of(labels)
    more = paired_in_full(lists.filter("b IS NULL").select("token", "a"), label, spans)
    if more is not None:
        checked = checked.unionAll(more)
        labels = components(checked.filter("linked"))
        label, spans = spans_of(labels)
    several = spans.filter("size > 1")
    open_pairs = (
        near.join(several.select(F.col("grp").alias("a")), "a", "left_semi")
        .unionAll(near.join(several.select(F.col("grp").alias("b")), "b", "left_semi").select("a", "b"))
        .unionAll(several.select("grp", F.col("grp").alias("b")))
    )
    side = lambda s: spans.select(F.col("grp").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))
    unsettled = open_pairs.distinct().join(side("a"), "a").join(side("b"), "b").filter(
        "NOT (lo_a = hi_a AND lo_b = hi_b AND lo_a = lo_b)"
    ).select("a", "b")
    # Two groups, or one of several classes, are a list too: its classes are paired in blocks, not expanded into rows.
    both = unsettled.select(F.xxhash64("a", "b").alias("token"), F.explode(F.array_distinct(F.array("a", "b"))).alias("a"))
    more = paired_in_full(both, label, spans)
    if more is not None:
        checked = checked.unionAll(more)
        labels = components(checked.filter("linked"))
    links = checked.filter("linked").select("a", "b", "common", "together")
    named = classes.join(labels, F.col("class") == F.col("v"), "left").select(
        "class", "rep", F.coalesce("label", "class").alias("label")
    )
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = common.stage(named.join(least, "label").select(F.col("class").alias("f_class"), "component_id"), "components")
    members = sets.select("doc_id", "text_key", "n", "class").join(
        final, (F.col("class") == F.col("f_class")) & (F.col("n") > 0), "left"
    ).select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), "class",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return members, classes, links


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id (rows without an id stay)."""
    members, _, _ = similar_documents(docs, id_column, text_column, width)
    keys = common.stage(
        members.filter("doc_id IS NOT NULL").groupBy("doc_id", "text_key")
        .agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "keys",
    )
    x_id, x_key = common.free_names(docs, "x_id", "x_key")
    here = (F.col(id_column) == F.col(x_id)) & (F.xxhash64(F.col(text_column)) == F.col(x_key))
    key = [F.col("doc_id").alias(x_id), F.col("text_key").alias(x_key)]
    dropped = common.stage(keys.filter("doc_id <> component_id").select(*key), "dropped")
    kept = docs.join(dropped, here, "left_anti")
    repeated = common.stage(keys.filter("n > 1 AND doc_id = component_id").select(*key), "repeated")
    if not repeated.limit(1).count():
        return kept
    # Rows of the same id and text are one document: one of them stays.
    once = kept.join(repeated, here, "left_semi").dropDuplicates([id_column, text_column])
    return kept.join(repeated, here, "left_anti").unionAll(once)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _, _ = similar_documents(common.table(spark, sf_dir, "documents"))
    return members.select("doc_id", "n_shingles", "component_id")
