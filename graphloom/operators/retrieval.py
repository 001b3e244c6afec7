"""Hybrid retrieval: vector and BM25 recall, rank fusion, shared-neighbour expansion, context selection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import unit_cosine
from graphloom.staging import stage


@dataclass(frozen=True)
class Limits:
    """Bounds of one retrieval; the values are fixed by the query semantics."""

    top_k: int = 5
    recall_k: int = 20
    scan_k: int = 100
    seeds: int = 5
    candidates: int = 100
    per_seed: int = 20
    entities_per_seed: int = 20
    edges_per_seed: int = 100
    anchors: int = 3
    window: int = 1
    chars: int = 12_000
    rrf_k: int = 60
    least_score: float = 0.0
    least_channels: int = 1


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The k best rows with their ``rank``, by (score descending, id)."""
    best = scored.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)).cast("int"))


def vector_scores(vectors: DataFrame, query: list[float], key: str = "vec_id", column: str = "embedding", floor: float | None = None) -> DataFrame:
    """(id, score): cosine in [0, 1], rounded so that ties are ties everywhere."""
    target = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(key).alias("id"), F.round(unit_cosine(F.col(column), target), 6).alias("score"))
    return scored.filter(F.col("score") >= floor) if floor is not None else scored.filter("score IS NOT NULL")


def rrf(channels: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """(id, score, channels): reciprocal rank fusion of ranked (id, rank) lists; an id counts once a channel."""
    union = None
    for name, ranked in channels.items():
        one = ranked.groupBy("id").agg(F.min("rank").alias("rank")).withColumn("channel", F.lit(name))
        union = one if union is None else union.unionByName(one)
    return union.groupBy("id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.count(F.lit(1)).alias("channels")
    )


def entity_degrees(mentions: DataFrame) -> DataFrame:
    """(entity_id, degree): distinct chunks that mention an entity."""
    return mentions.groupBy("entity_id").agg(F.count_distinct("chunk_id").alias("degree"))


def expand(mentions: DataFrame, seeds: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(seed, candidate, score, rank): chunks that share entities with a seed, by the sum of 1 / degree.

    A seed's best entities come first by confidence, and with ``edges_per_seed`` its first edges by (candidate, entity). Only
    the entities of the seeds are joined back to the mentions, so the work follows the seeds' neighbourhoods.
    """
    by_confidence = Window.partitionBy("seed").orderBy(F.desc("confidence"), "entity_id")
    of_seeds = (
        mentions.join(seeds.select(F.col("id").alias("seed")), F.col("chunk_id") == F.col("seed"))
        .select("seed", "entity_id", "confidence")
        .withColumn("n", F.row_number().over(by_confidence)).filter(F.col("n") <= limits.entities_per_seed)
        .select("seed", "entity_id")
    )
    of_seeds = stage(of_seeds, "seed-entities")
    wanted = of_seeds.select("entity_id").distinct()
    touched = stage(mentions.join(wanted, "entity_id", "left_semi").select("entity_id", "chunk_id").distinct(), "touched")
    shared = of_seeds.join(touched.withColumnRenamed("chunk_id", "candidate"), "entity_id").filter("candidate <> seed")
    edges = shared.join(entity_degrees(touched), "entity_id")
    if limits.edges_per_seed:
        by_place = Window.partitionBy("seed").orderBy("candidate", "entity_id")
        edges = edges.withColumn("n", F.row_number().over(by_place)).filter(F.col("n") <= limits.edges_per_seed)
    scored = edges.groupBy("seed", "candidate").agg(F.round(F.sum(1.0 / F.col("degree")), 6).alias("score"))
    order = Window.partitionBy("seed").orderBy(F.desc("score"), "candidate")
    return scored.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= limits.per_seed)


def merge_in_order(channels: list[DataFrame], most: int) -> DataFrame:
    """(id, place): the ids of ranked (id, rank) lists, one list after another; the first occurrence counts, ``most`` stay."""
    union = None
    for k, ranked in enumerate(channels):
        one = ranked.select("id", F.struct(F.lit(k).alias("channel"), F.col("rank")).alias("at"))
        union = one if union is None else union.unionByName(one)
    first = union.groupBy("id").agg(F.min("at").alias("at")).orderBy("at").limit(most)
    return first.select("id", F.row_number().over(Window.orderBy("at")).cast("int").alias("place"))


@dataclass(frozen=True)
class Retrieved:
    """The ranked lists of one retrieval: each holds at most as many rows as its limit says."""

    vector: DataFrame
    words: DataFrame
    expanded: DataFrame
    merged: DataFrame
    ranked: DataFrame


def retrieve(vectors: DataFrame, words: DataFrame, mentions: DataFrame, scope: DataFrame, limits: Limits = Limits()) -> Retrieved:
    """Recall by vectors and words, fusion, expansion from the best, re-score and final fusion, all inside ``scope`` (id).

    ``vectors`` and ``words`` are scored (id, score) of everything; of the words only the best ``scan_k`` are looked at. What may not
    be read reaches neither a ranking nor a degree. Lists that are used again are bounded by the limits and stored.
    """
    allowed = stage(scope.select("id").distinct(), "scope")
    scored = stage(vectors.filter(F.col("score") >= limits.least_score).join(allowed, "id", "left_semi"), "vector-scores")
    by_vector = stage(top_k(scored, limits.recall_k), "by-vector")
    scanned = words.filter(F.col("score") >= limits.least_score).orderBy(F.desc("score"), "id").limit(limits.scan_k)
    by_words = stage(top_k(scanned.join(allowed, "id", "left_semi"), limits.recall_k), "by-words")
    seeds = stage(top_k(rrf({"vector": by_vector, "words": by_words}, limits.rrf_k), limits.seeds), "seeds")
    readable = mentions.join(allowed.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_semi")
    expanded = stage(expand(readable, seeds, limits).join(seeds.select(F.col("id").alias("seed"), F.col("rank").alias("seed_rank")), "seed"), "expanded")
    near = expanded.select(F.col("candidate").alias("id"), (F.col("seed_rank") * (limits.per_seed + 1) + F.col("rank")).alias("rank"))
    merged = stage(merge_in_order([by_vector, by_words, near], limits.candidates), "merged")
    again = top_k(scored.join(merged.select("id"), "id", "left_semi"), limits.candidates)
    final = rrf({"vector": again, "words": by_words}, limits.rrf_k).filter(F.col("channels") >= limits.least_channels)
    ranked = final.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("int"))
    return Retrieved(by_vector, by_words, expanded, merged, stage(ranked, "ranked"))


def context_of(ranked: DataFrame, chunks: DataFrame, scope: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(position, id, role, size, decision) of every chunk considered: anchors, then their neighbours, then the ranking.

    ``chunks``: (id, document_id, ordinal, size, content). All are looked up in ``scope`` once more, and what is not there any more is
    rejected; of equal contents the first stays. The decision is 'selected' or why not. Not more than the limits' rows are sorted.
    """
    allowed = chunks.join(scope.select("id").distinct(), "id", "left_semi")
    gone = ranked.join(allowed.select("id"), "id", "left_anti").select("id", "rank", F.lit("final_authorization_or_version_check").alias("decision"))
    anchors = ranked.filter(F.col("rank") <= limits.anchors).join(allowed, "id").select(
        F.col("rank").alias("anchor"), F.col("id").alias("a_id"), "document_id", F.col("ordinal").alias("a_ordinal")
    )
    reach = F.explode(F.sequence(F.col("a_ordinal") - limits.window, F.col("a_ordinal") + limits.window)).alias("ordinal")
    neighbours = allowed.join(anchors.select("anchor", "a_id", "document_id", "a_ordinal", reach), ["document_id", "ordinal"]).filter("id <> a_id")
    order = ["anchor", F.abs(F.col("ordinal") - F.col("a_ordinal")), "ordinal", "id"]
    beside = neighbours.orderBy(*order).limit(limits.anchors * max(1, limits.window) * 2)
    beside = beside.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))
    listed = ranked.select("id", F.lit(0).alias("part"), "rank").unionByName(beside.select("id", F.lit(1).alias("part"), "rank"))
    first = listed.groupBy("id").agg(F.min(F.struct("part", "rank")).alias("at")).join(allowed, "id")
    same = F.row_number().over(Window.partitionBy("content").orderBy("at"))
    known = first.withColumn("nth", same)
    # Bounded by the limits: the ranking and the neighbours of its first rows.
    kept = known.filter("nth = 1").withColumn("place", F.row_number().over(Window.partitionBy("at.part").orderBy("at")))
    role = F.when(F.col("at.part") == 1, "adjacent").when(F.col("place") <= limits.anchors, "anchor").otherwise("ranked")
    turn = F.when(role == "anchor", 0).when(role == "adjacent", 1).otherwise(2)
    queue = kept.select("id", role.alias("role"), "size", F.row_number().over(Window.orderBy(turn, "place")).cast("int").alias("position"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        taken, used, decisions = 0, 0, []
        frame = frame.sort_values("position")
        for size in frame["size"]:
            if taken >= limits.top_k:
                decisions.append("chunk_limit")
            elif not size > 0:
                decisions.append("missing_or_empty")
            elif used + size > limits.chars:
                decisions.append("character_budget")
            else:
                taken, used = taken + 1, used + size
                decisions.append("selected")
        return frame.assign(decision=decisions)

    chosen = queue.groupBy(F.lit("").alias("all")).applyInPandas(choose, "id long, role string, size long, position int, decision string")
    none = F.lit(None)
    rejected = known.filter("nth > 1").select("id", F.lit("duplicate_content").alias("decision")).unionByName(gone.select("id", "decision"))
    return chosen.select("position", "id", "role", "size", "decision").unionByName(
        rejected.select(none.cast("int").alias("position"), "id", none.cast("string").alias("role"), none.cast("long").alias("size"), "decision")
    )


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Stable dedup: the first row of each key in the given order."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def adjacent(chunks: DataFrame, anchors: DataFrame, window: int, key: str = "doc_id") -> DataFrame:
    """Neighbouring chunks (``distance`` other than 0) of the anchors (key, ordinal): an equi join on the wanted ordinals."""
    wanted = anchors.select(
        F.col(key), F.col("ordinal").alias("anchor"),
        F.explode(F.sequence(F.col("ordinal") - window, F.col("ordinal") + window)).alias("ordinal"),
    ).filter("ordinal <> anchor")
    return chunks.join(wanted, [key, "ordinal"]).withColumn("distance", F.col("ordinal") - F.col("anchor"))


def select_context(candidates: DataFrame, most: int, chars: int, group: str) -> DataFrame:
    """Greedy choice in order of ``position``: at most ``most`` chunks and ``chars`` characters; what does not fit is skipped.

    A group's rows (id, size and position alone) pass one after another in batches; a group of any size is never held whole.
    """

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken, used = None, 0, 0
        for frame in frames:
            kept = []
            for key, size in zip(frame[group], frame["size"], strict=True):
                if key != now:
                    now, taken, used = key, 0, 0
                fits = taken < most and used + size <= chars
                kept.append(fits)
                taken, used = taken + fits, used + (size if fits else 0)
            yield frame[kept]

    ordered = candidates.filter(F.col("size") <= chars).repartition(group).sortWithinPartitions(group, "position", "id")
    return ordered.mapInPandas(choose, candidates.schema)


def source_window(text: Column, term: str, chars: int) -> Column:
    """A window of at most ``chars`` around the first hit of the term, or the head of the text."""
    at = F.instr(F.lower(text), term.lower())
    start = F.when(at > 0, F.greatest(F.lit(0), F.least(at - 1 - (chars - len(term)) // 2, F.length(text) - chars))).otherwise(0)
    return F.substring(text, start + 1, F.lit(chars))
