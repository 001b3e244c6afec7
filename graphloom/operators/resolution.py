"""Entity resolution, reference resolution and fact assessment."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from graphloom.functions.text import name_key
from graphloom.staging import many, stage


def resolve_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, decision) of pairs that share a code or a name key; both have (id, entity_type, nation, code, name).

    Two equi joins instead of one join on OR, so neither compares all pairs.
    """
    a, b = ({c: f"{c}_{x}" for c in ("id", "entity_type", "nation", "code", "key")} for x in "ab")
    l = left.withColumn("key", name_key(F.col("name"))).select(*[F.col(k).alias(v) for k, v in a.items()])
    r = right.withColumn("key", name_key(F.col("name"))).select(*[F.col(k).alias(v) for k, v in b.items()])
    pairs = l.join(r, F.col("code_a") == F.col("code_b")).unionByName(
        l.join(r, F.col("key_a") == F.col("key_b")).filter("NOT (code_a <=> code_b)")
    )
    decision = (
        F.when(F.col("entity_type_a") != F.col("entity_type_b"), "KEEP_SEPARATE").when(F.col("code_a") == F.col("code_b"), "MERGE")
        .when(F.col("nation_a") != F.col("nation_b"), "KEEP_SEPARATE").otherwise("HUMAN_REVIEW")
    )
    return pairs.select(F.col("id_a").alias("left_id"), F.col("id_b").alias("right_id"), decision.alias("decision"))


def ladder(candidates: DataFrame, authorities: DataFrame) -> DataFrame:
    """(candidate_id, step, match_id, confidence): the canonical key decides before the exact name; several matches conflict."""
    by_code = authorities.groupBy(F.col("code").alias("k_code")).agg(F.count(F.lit(1)).alias("k_n"), F.min("id").alias("k_id"))
    by_name = authorities.groupBy(name_key(F.col("name")).alias("m_key")).agg(F.count(F.lit(1)).alias("m_n"), F.min("id").alias("m_id"))
    found = candidates.join(by_code, F.col("code") == F.col("k_code"), "left").join(by_name, name_key(F.col("name")) == F.col("m_key"), "left")
    key, name = F.col("k_n") == 1, F.col("k_n").isNull() & (F.col("m_n") == 1)
    step = (
        F.when(F.col("k_n") > 1, "CONFLICT").when(key, "CANONICAL_KEY").when(F.col("m_n") > 1, "CONFLICT").when(F.col("m_n") == 1, "EXACT_NAME")
        .otherwise("NO_MATCH")
    )
    return found.select(
        F.col("id").alias("candidate_id"), step.alias("step"), F.when(key, F.col("k_id")).when(name, F.col("m_id")).alias("match_id"),
        F.when(key, 1.0).when(name, 0.98).alias("confidence"),
    )


def full_ladder(candidates: DataFrame, authorities: DataFrame, identified: bool = False, least: float = 0.84) -> DataFrame:
    """(candidate_id, step, match_id, confidence) for candidates and authorities (id, code, identity, name, aliases) of one entity type.

    The canonical key decides first. With ``identified`` (a type that declares identity properties) these decide the rest, and a
    candidate without them conflicts. Otherwise follow the governed alias, the exact name and the most similar name, where a
    candidate's name and aliases all count. Several matches of an exact step conflict.
    """
    names = lambda rows, *c: rows.select("id", F.explode(F.array_distinct(F.transform(
        F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in c]), name_key
    ))).alias("key")).filter("key <> ''")
    name, aliases = F.array("name"), F.col("aliases")
    of = lambda rows, c: rows.select("id", F.col(c).alias("key"))

    def hits(wanted: DataFrame, known: DataFrame, x: str) -> DataFrame:
        # None, one or several: the least and the greatest of a key's authorities tell, so copies of a name are not paired.
        ends = known.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"))
        both = wanted.join(many(ends), "key").groupBy("id").agg(F.min("least").alias(f"{x}_id"), F.max("most").alias("most"))
        n = F.when(F.col(f"{x}_id") != F.col("most"), 2).when(F.col("most").isNotNull(), 1).otherwise(0)
        return both.select("id", n.alias(f"{x}_n"), f"{x}_id")

    by_key = hits(of(candidates, "code"), of(authorities, "code"), "k")
    found = candidates.select("id", "identity").join(by_key, "id", "left")
    key = F.when(F.col("k_n") > 1, "CONFLICT").when(F.col("k_n") == 1, "CANONICAL_KEY")
    match, confidence = F.when(F.col("k_n") == 1, F.col("k_id")), F.when(F.col("k_n") == 1, 1.0)
    if identified:
        found = found.join(hits(of(candidates, "identity"), of(authorities, "identity"), "i"), "id", "left")
        step = key.when(F.col("identity").isNull() | (F.col("i_n") > 1), "CONFLICT").when(F.col("i_n") == 1, "IDENTITY_PROPERTIES")
        none = F.col("k_n").isNull() & (F.col("i_n") == 1)
        match, confidence = match.when(none, F.col("i_id")), confidence.when(none, 1.0)
    else:
        called = names(candidates, name, aliases)
        by_alias, by_name = hits(called, names(authorities, aliases), "a"), hits(called, names(authorities, name), "m")
        rest = called
        for exact in (by_key, by_alias, by_name):
            rest = rest.join(exact.select("id"), "id", "left_anti")
        near = similar_names(
            rest.withColumnRenamed("key", "name_key"), names(authorities, name, aliases).toDF("authority_id", "authority_key"), least, 1
        ).select("id", F.col("authority_id").alias("s_id"), "ratio")
        found = found.join(by_alias, "id", "left").join(by_name, "id", "left").join(near, "id", "left")
        step = (
            key.when(F.col("a_n") > 1, "CONFLICT").when(F.col("a_n") == 1, "GOVERNED_ALIAS")
            .when(F.col("m_n") > 1, "CONFLICT").when(F.col("m_n") == 1, "EXACT_NAME").when(F.col("ratio").isNotNull(), "SIMILAR_NAME")
        )
        for open_, x, value in (
            (F.col("k_n").isNull() & (F.col("a_n") == 1), "a_id", F.lit(0.995)),
            (F.coalesce("k_n", "a_n").isNull() & (F.col("m_n") == 1), "m_id", F.lit(0.98)),
            (F.coalesce("k_n", "a_n", "m_n").isNull(), "s_id", F.col("ratio")),
        ):
            match, confidence = match.when(open_, F.col(x)), confidence.when(open_, value)
    return found.select(F.col("id").alias("candidate_id"), step.otherwise("NO_MATCH").alias("step"), match.alias("match_id"), confidence.alias("confidence"))


def _bag(key: Column) -> Column:
    """A key's characters in order: keys of one bag have all characters in common."""
    return F.array_join(F.array_sort(F.regexp_extract_all(key, F.lit("(?s)."), F.lit(0))), "")


def _tokens(bag: str) -> Column:
    """A bag's characters, each with its number among its likes: what two bags have in common, these share as sets."""
    chars = F.regexp_extract_all(F.col(bag), F.lit("(?s)."), F.lit(0))
    runs = F.transform(chars, lambda c, i: F.concat(c, (i - F.array_position(chars, c) + 1).cast("string")))
    return F.when(F.length(bag) == 0, F.array(F.lit(""))).otherwise(runs)  # empty keys meet one another


def _similar_bags(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, bound): bags (a), (b) whose characters in common, 2 * common / total, let a ratio reach ``least``, with that bound.

    At least t / (2 - t) of a bag's characters must be in common, so one of the rarest n - that + 1 is: bags meet by these.
    """
    sides, short = {}, {}
    for x, rows in (("a", left), ("b", right)):
        sides[x] = stage(rows.select(x).distinct().select(x, _tokens(x).alias(f"t_{x}"), F.length(x).alias(f"n_{x}")), "name-bags")
    rare = sides["b"].select(F.explode("t_b").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    for x, side in sides.items():
        kept = F.greatest(F.lit(1), F.col(f"n_{x}") - F.ceil(F.col(f"n_{x}") * (least / (2 - least)) - 1e-6) + 1)
        each = side.select(x, f"n_{x}", F.explode(f"t_{x}").alias("token"))
        counted = each.join(rare, "token", "left").withColumn("held", F.coalesce("held", F.lit(0).cast("long")))
        place = F.row_number().over(Window.partitionBy(x).orderBy("held", "token"))
        short[x] = counted.withColumn("place", place).filter(F.col("place") <= kept).select("token", x, f"n_{x}")
    total = F.greatest(F.col("n_a") + F.col("n_b"), F.lit(1))
    met = short["a"].join(many(short["b"]), "token").filter(2 * F.least("n_a", "n_b") >= (least - 1e-6) * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct()
    bound = 2 * F.size(F.array_intersect("t_a", "t_b")) / total
    return met.join(many(sides["a"]), "a").join(many(sides["b"]), "b").select("a", "b", bound.alias("bound")).filter(F.col("bound") >= least - 1e-6)


def _frame(key: Column) -> Column:
    """The bag of a key with all digits as one character: numbered names share it, and what two frames have in common bounds their keys' too."""
    return _bag(F.regexp_replace(key, "[0-9]", "0"))


def _each_rest(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, n_a, n_b, m) without these sizes and with ``rest``: the hash of each different text of m characters that deletions leave of the key.

    Keys have m characters in common, in their order, if and only if they share such a text; equal hashes of different ones only add pairs.
    """

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rest = [], []
            for i, (text, m) in enumerate(zip(batch.column(key).to_pylist(), batch.column("m").to_pylist(), strict=True)):
                left = {"".join(chars) for chars in combinations(text, m)}
                at += [i] * len(left)
                rest += left
                if len(rest) >= 50_000:
                    yield _taken(batch, at, "rest", pa.array(rest, pa.string()))
                    at, rest = [], []
            yield _taken(batch, at, "rest", pa.array(rest, pa.string()))

    each = rows.mapInArrow(deleted, StructType([*rows.schema.fields, StructField("rest", StringType())]))
    return each.withColumn("rest", F.xxhash64("rest", "n_a", "n_b")).drop("m", "n_a", "n_b")


def _taken(batch: pa.RecordBatch, at: list[int], name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), values], [*batch.schema.names, name])


def _aligned(rows: DataFrame) -> DataFrame:
    """``rows`` (a, b, bound, rest) with their ratio; of those of one (a, rest) that follow one another none after the first that reaches its bound."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch in batches:
            at, ratios = [], []
            for i, (x, y, bound, rest) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "bound", "rest")), strict=True)):
                if (x, rest) != done:
                    at.append(i)
                    ratios.append(SequenceMatcher(None, x, y).ratio())
                    done = (x, rest) if ratios[-1] >= bound - 1e-9 else None
            yield _taken(batch, at, "ratio", pa.array(ratios, pa.float64()))

    return rows.mapInArrow(align, StructType([*rows.schema.fields, StructField("ratio", DoubleType())]))


def _nearest_by_rest(left: DataFrame, right: DataFrame, frames: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(a, first, b, ratio) of keys (a, frame_a) that are nearest to one of (b, frame_b, first), and the pairs of frames whose keys are still to be aligned.

    ``first`` orders what is equally near. In the k-th round keys meet that have all characters but k of the shorter one in common, by what
    deletions leave of them; a key whose nearest is as near as a round allows is out of it. Of the keys that leave one text the first is aligned, the
    others where it falls short of the bound. Pairs of frames with fewer pairs of keys than rests are left to be aligned as they are.
    """
    held = lambda rows, x: rows.groupBy(f"frame_{x}").agg(F.count(F.lit(1)).alias(f"held_{x}"))
    sized = frames.join(held(left, "a"), "frame_a").join(held(right, "b"), "frame_b")
    open_ = stage(sized.select("*", F.length("frame_a").alias("n_a"), F.length("frame_b").alias("n_b")), "name-frames")
    far = open_.select("frame_a", "frame_b").limit(0)
    nothing = left.sparkSession.createDataFrame([], StructType([f for f in left.select("a").schema] + [f for f in right.select("first", "b").schema] + [StructField("ratio", DoubleType())]))
    best, k = nothing, 0
    total = F.col("n_a") + F.col("n_b")
    bound = F.when(total == 0, 1.0).otherwise(2 * F.col("m") / F.greatest(total, F.lit(1)))  # empty keys are alike
    nearer = F.col("had").isNull() | (F.round("bound", 6) >= F.col("had"))
    deletions = lambda n, p: F.when(p < 1, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(p, F.lit(1))), F.lit(1.0), lambda x, i: x * (n - p + i) / i))
    while True:
        level = open_.withColumn("m", F.least("n_a", "n_b") - k).withColumn("bound", bound).filter((F.col("m") >= 0) & (F.col("bound") >= least - 1e-6))
        had = many(best.select("a", F.col("ratio").alias("had")))
        wanted = left.join(level, "frame_a").join(had, "a", "left").filter(nearer)
        if k:  # names of a frame that are still to be found
            level = level.drop("held_a").join(wanted.groupBy("frame_a", "frame_b").agg(F.count(F.lit(1)).alias("held_a")), ["frame_a", "frame_b"])
        rests = F.col("held_a") * deletions(F.col("n_a"), F.col("n_a") - F.col("m")) + F.col("held_b") * deletions(F.col("n_b"), F.col("n_b") - F.col("m"))
        level = stage(level.withColumn("few", rests >= F.col("held_a").cast("double") * F.col("held_b")), "name-levels")
        n, n_few = level.agg(F.count(F.lit(1)), F.count_if("few")).first()
        few, rich = level.filter("few"), level.filter("NOT few")
        if n_few:
            far = far.unionByName(few.select("frame_a", "frame_b"))
        if n == n_few:
            return best, far
        open_ = stage(open_.drop("held_a").join(rich.select("frame_a", "frame_b", "held_a"), ["frame_a", "frame_b"]), "name-frames")
        asked = wanted.join(rich.select("frame_a", "frame_b"), ["frame_a", "frame_b"]).select("a", "n_a", "n_b", "m").distinct()
        known = right.join(rich.select("frame_b", "n_a", "n_b", "m").distinct(), "frame_b").select("b", "first", "n_a", "n_b", "m")
        of_b = stage(_each_rest(known, "b"), "name-rests")
        first = of_b.groupBy("rest").agg(F.min(F.struct("first", "b")).alias("top"), F.count(F.lit(1)).alias("n"))
        of_a = _each_rest(asked.withColumn("bound", bound), "a")
        tried = of_a.join(many(first), "rest").select("a", "rest", "bound", "top.first", "top.b", "n")
        tried = stage(_aligned(tried), "name-tries")
        short = tried.filter("n > 1 AND ratio < bound - 1e-9").select("a", "rest", "bound", F.col("first").alias("tried"))

        def better(found: DataFrame) -> DataFrame:
            found = found.select("a", "first", "b", F.round("ratio", 6).alias("ratio")).filter(F.col("ratio") >= least)
            top = best.unionByName(found).groupBy("a").agg(F.min(F.struct((-F.col("ratio")).alias("unlike"), "first", "b")).alias("top"))
            return stage(top.select("a", "top.first", "top.b", (-F.col("top.unlike")).alias("ratio")), "name-nearest")

        best = better(tried)
        after = many(best.select("a", F.col("ratio").alias("had"), F.col("first").alias("had_first")))
        behind = F.col("had").isNull() | (F.round("bound", 6) > F.col("had")) | ((F.round("bound", 6) == F.col("had")) & (F.col("tried") < F.col("had_first")))
        short = short.join(after, "a", "left").filter(behind).select("a", "rest", "bound", "tried")
        others = short.join(many(of_b), "rest").filter(F.col("first") > F.col("tried")).select("a", "rest", "bound", "first", "b")
        best = better(_aligned(others.sortWithinPartitions("a", "rest", "first")))
        k += 1


def similar_names(names: DataFrame, authorities: DataFrame, least: float, most: int) -> DataFrame:
    """(id, authority_id, ratio, rank): for each (id, name_key) the most similar of (authority_id, authority_key) by matching blocks.

    ``least`` is above 0. The characters in common bound the ratio from above, so keys meet by the rarest of these (an inverted index, no
    comparison of all pairs); keys that differ in digits alone meet as one. If one authority is wanted, those of many names are found by
    what deletions leave of them. The others are aligned from the highest bound on, as long as the bound reaches what the ``most`` best have. Equal
    keys are aligned once. Ties go to the smaller authority_id. Null keys resemble nothing, empty ones one another. Rows that share an id are
    ranked together; empty tables give no rows.
    """
    if not 0 < least <= 1:
        raise ValueError(f"least is above 0 and at most 1, not {least}")
    framed = lambda rows, x: stage(rows.withColumn(f"frame_{x}", _frame(F.col(x))), "name-keys")
    left = framed(names.select(F.col("name_key").alias("a")).dropna().distinct(), "a")
    known = authorities.select(F.col("authority_key").alias("b"), "authority_id").dropna(subset=["b"])
    right = framed(known.groupBy("b").agg(F.min(F.struct("authority_id")).alias("first")), "b")
    frames = stage(_similar_bags(left.select(F.col("frame_a").alias("a")), right.select(F.col("frame_b").alias("b")), least).select(
        F.col("a").alias("frame_a"), F.col("b").alias("frame_b")), "name-frames")
    best, frames = _nearest_by_rest(left, right, frames, least) if most == 1 else (None, frames)

    bagged = lambda rows, x: rows.withColumn(f"bag_{x}", _bag(F.col(x)))
    l, r = bagged(left.join(frames, "frame_a"), "a"), bagged(right.join(frames.select("frame_b").distinct(), "frame_b"), "b")
    if best is not None:
        l = l.join(many(best.select("a", F.col("ratio").alias("had"))), "a", "left")
    sides = l.select("bag_a", "frame_b").distinct().withColumn("t_a", _tokens("bag_a")).join(r.select("bag_b", "frame_b").distinct().withColumn("t_b", _tokens("bag_b")), "frame_b")
    bound = 2 * F.size(F.array_intersect("t_a", "t_b")) / F.greatest(F.length("bag_a") + F.length("bag_b"), F.lit(1))
    bags = stage(sides.select("bag_a", "bag_b", "frame_b", bound.alias("bound")).filter(F.col("bound") >= least - 1e-6), "name-bags")
    both = l.join(many(bags), ["bag_a", "frame_b"]).join(many(r.select("b", "bag_b")), "bag_b")
    if best is not None:
        both = both.filter("had IS NULL OR bound >= had - 1e-6")

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, best = None, []  # of the key at hand, the ``most`` highest ratios
        for frame in frames:
            rows = []
            for x, y, bound in zip(frame["a"], frame["b"], frame["bound"], strict=True):
                if x != now:
                    now, best = x, []
                if len(best) == most and bound < best[0] - 1e-6:
                    continue
                ratio = SequenceMatcher(None, x, y).ratio()
                if ratio >= least - 1e-6:
                    rows.append((x, y, ratio))
                    best = sorted([*best, ratio])[-most:]
            yield pd.DataFrame(rows, columns=["a", "b", "ratio"])

    dealt = both.select("a", "b", "bound").repartition("a").sortWithinPartitions("a", F.desc("bound"))
    scored = dealt.mapInPandas(align, "a string, b string, ratio double").withColumn("ratio", F.round("ratio", 6)).filter(F.col("ratio") >= least)
    if best is not None:
        scored = scored.unionByName(best.select("a", "b", "ratio"))
    # Of the authorities of one key, and of what one key found, no more than ``most`` can be among the best.
    first = lambda rows, by, *order: rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= most)
    order = (F.desc("ratio"), "authority_id")
    found = first(scored.join(many(first(known, "b", "authority_id").drop("rank")), "b"), "a", *order).drop("rank")
    return first(names.select("id", F.col("name_key").alias("a")).join(many(found), "a"), "id", *order).select("id", "authority_id", "ratio", "rank")


def classify_facts(new: DataFrame, published: DataFrame) -> DataFrame:
    """(subject, signature, state) of new facts against the published meanings of their subject."""
    known = published.groupBy(F.col("subject").alias("k_subject")).agg(F.collect_set("signature").alias("known"))
    state = (
        F.when(F.col("signature").isNull(), "UNAVAILABLE").when(F.col("known").isNull(), "READY")
        .when(F.array_contains("known", F.col("signature")), "DUPLICATE").otherwise("CONFLICT")
    )
    return new.join(known, F.col("subject") == F.col("k_subject"), "left").select("subject", "signature", state.alias("state"))


def resolve_references(references: DataFrame, targets: DataFrame) -> DataFrame:
    """(record_id, state, target_id): RESOLVED if exactly one target has the key, else UNRESOLVED or AMBIGUOUS."""
    by_key = targets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    state = F.when(F.col("n").isNull(), "UNRESOLVED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("RESOLVED")
    return references.join(by_key, F.col("value") == F.col("key"), "left").select(
        "record_id", state.alias("state"), F.when(F.col("n") == 1, F.col("id")).alias("target_id")
    )
