"""Evidence subgraphs: what the chunks chosen for many requests mention, and the assertions that touch it, within budgets.

A mention or assertion counts only with evidence that stands in a chunk which the reader may read, under that chunk's policy, by an
admitted authority, under the publication's ontology. Each request's candidates are cut to its row limits before they are gathered, and of
an entity only as many assertions as a request can take are joined to it, so an entity that a third of all assertions touch costs
no more than any other.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import access
from graphloom.operators.governed import trusted


@dataclass(frozen=True)
class Limits:
    """Budgets of one request; the defaults are fixed by the query semantics."""

    chunks: int = 20
    entities: int = 100
    assertions: int = 100
    paths: int = 100
    mentions_per_entity: int = 10
    chunk_chars: int = 20_000
    evidence_chars: int = 100_000

    def __post_init__(self) -> None:
        if min(asdict(self).values()) < 1:
            raise ValueError(f"limits are positive, not {self}")


def _in_chunk(rows: DataFrame, chunks: DataFrame, who: access.Principal, trust: str, ontology: str) -> DataFrame:
    """Published rows of evidence with ``chunk_size``, where all that binds them to their chunk holds."""
    c = chunks.select(*[F.col(k).alias(f"c_{k}") for k in ("chunk_id", "document_id", "version_id", "policy_id", "policy_version", "access_groups", "char_start", "char_end", "text")])
    own = trusted(access.authorized(rows, who), trust).filter((F.col("status") == "PUBLISHED") & (F.col("ontology") == ontology))
    same = F.col("chunk_id") == F.col("c_chunk_id")
    for k in ("document_id", "version_id", "policy_id", "policy_version", "access_groups"):
        same &= F.col(k) == F.col(f"c_{k}")
    inside = (F.col("c_char_start") <= F.col("char_start")) & (F.col("char_start") < F.col("char_end")) & (F.col("char_end") <= F.col("c_char_end"))
    exact = F.substr("c_text", F.col("char_start") - F.col("c_char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("quoted")
    return own.join(c, same & inside & exact).select(*[F.col(f"`{k}`") for k in rows.columns], F.length("c_text").alias("chunk_size"))


def governed_mentions(mentions: DataFrame, entities: DataFrame, types: DataFrame, chunks: DataFrame, who: access.Principal, trust: str, ontology: str) -> DataFrame:
    """Mentions that hold: (revision_id, tenant_id, status, authority, ontology, entity_id, entity_type, chunk_id, document_id, version_id,
    policy_id, policy_version, access_groups, char_start, char_end, quoted) of entities (entity_id, entity_type) of declared types (name).
    """
    e = entities.join(types.select(F.col("name").alias("entity_type")), "entity_type", "left_semi").select("entity_id", "entity_type")
    return _in_chunk(mentions, chunks, who, trust, ontology).join(e, ["entity_id", "entity_type"], "left_semi")


def governed_assertions(
    assertions: DataFrame, mentions: DataFrame, relations: DataFrame, properties: DataFrame, chunks: DataFrame, who: access.Principal, trust: str, ontology: str
) -> DataFrame:
    """Assertions that hold, with both of their ends.

    assertions have the columns of evidence, and predicate, subject_id, subject_mention, object_kind, object_id, object_mention, literal;
    ``mentions`` are governed ones. Ends are mentions of these entities in the same chunk, inside the assertion's evidence. A relationship is declared
    (relations: name, source_type, target_type) for the types of its ends; a literal's property (properties: entity_type, name) is
    declared for the subject's type, and its text stands in the evidence. Declarations are few and are broadcast if Spark finds them small.
    """
    own = _in_chunk(assertions, chunks, who, trust, ontology)

    def end(x: str) -> DataFrame:
        return mentions.select(*[F.col(k).alias(f"{x}_{k}") for k in ("revision_id", "entity_id", "entity_type", "chunk_id", "char_start", "char_end", "quoted")])

    def bound(x: str, entity: str, mention: str) -> Column:
        return (
            (F.col(mention) == F.col(f"{x}_revision_id")) & (F.col(entity) == F.col(f"{x}_entity_id")) & (F.col("chunk_id") == F.col(f"{x}_chunk_id"))
            & (F.col("char_start") <= F.col(f"{x}_char_start")) & (F.col(f"{x}_char_end") <= F.col("char_end"))
        )

    both = own.join(end("s"), bound("s", "subject_id", "subject_mention")).join(end("o"), bound("o", "object_id", "object_mention"), "left")
    r = relations.select(F.col("name").alias("r_name"), F.col("source_type").alias("r_source"), F.col("target_type").alias("r_target")).distinct()
    p = properties.select(F.col("entity_type").alias("p_type"), F.col("name").alias("p_name")).distinct()
    related = both.filter("object_kind = 'entity'").join(
        r, (F.col("predicate") == F.col("r_name")) & (F.col("s_entity_type") == F.col("r_source")) & (F.col("o_entity_type") == F.col("r_target")), "left_semi")
    literal = both.filter("object_kind = 'literal' AND object_id IS NULL AND object_mention IS NULL AND literal <> '' AND contains(quoted, literal)").join(
        p, (F.col("predicate") == F.col("p_name")) & (F.col("s_entity_type") == F.col("p_type")), "left_semi")
    return related.unionByName(literal)


def admit(rows: list[dict], limits: Limits) -> list[str]:
    """What becomes of one request's rows, mentions first, each in order: admitted, or the first limit that keeps it out.

    An assertion is admitted with the evidence of both of its ends or not at all, and only if its seed entity has evidence in its seed chunk.
    """
    attached: dict[str, dict[str, str]] = {}  # entity -> revision -> chunk
    reserved: set[tuple] = set()
    used, taken, out = 0, 0, []

    def room(ends: list[tuple]) -> str | None:
        if len(attached.keys() | {entity for entity, *_ in ends}) > limits.entities:
            return "entity_limit"
        if any(entity in attached and revision not in attached[entity] and len(attached[entity]) >= limits.mentions_per_entity for entity, revision, *_ in ends):
            return "mention_limit"
        return None

    for row in rows:
        if row["kind"] == "assertion":
            if taken >= limits.assertions:
                out.append("assertion_limit")
                continue
            if row["seed_chunk"] not in attached.get(row["seed"], {}).values():
                out.append("seed_not_admitted")
                continue
        reason = room(row["ends"])
        if reason is None:
            items = {(revision, row["chunk_id"], a, b): b - a for revision, a, b in row["evidence"]}
            cost = sum(size for key, size in items.items() if key not in reserved)
            if any(key not in reserved for key in items) and ("CHUNK", row["chunk_id"]) not in reserved:
                cost += row["chunk_size"]
            if used + cost > limits.evidence_chars:
                reason = "character_budget"
            else:
                used += cost
                reserved |= {*items, ("CHUNK", row["chunk_id"])}
                for entity, revision, chunk in row["ends"]:
                    own = attached.setdefault(entity, {})
                    if len(own) < limits.mentions_per_entity:
                        own.setdefault(revision, chunk)
                taken += row["kind"] == "assertion"
        out.append(reason or "admitted")
    return out


def evidence_subgraphs(requests: DataFrame, mentions: DataFrame, assertions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(request_id, kind, revision_id, entity_id, chunk_id, decision, path) of every candidate of every request (request_id, chunk_id).

    ``mentions`` and ``assertions`` are governed ones. Candidates are the mentions in a request's chunks, by (entity, revision), at most
    entities * mentions_per_entity of them, and the assertions that touch one of its first entities, by revision, as many as the limit. An
    admitted assertion is a path if it is among the first ``paths``. A request of more than ``chunks`` chunks has one row of kind request, ``chunk_limit``.
    Repeated requests and chunks count once; a request without readable mentions has no rows; chunks of more than ``chunk_chars`` characters are not evidence.
    """
    asked = requests.select("request_id", "chunk_id").dropna().distinct()
    n = asked.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    over = n.filter(F.col("n") > limits.chunks).select("request_id")
    asked = asked.join(over, "request_id", "left_anti")
    fits = lambda rows: rows.filter(F.col("chunk_size") <= limits.chunk_chars)
    by_entity = Window.partitionBy("request_id").orderBy("entity_id", "revision_id")
    met = asked.join(fits(mentions), "chunk_id")
    seeds = met.groupBy("request_id", F.col("entity_id").alias("seed")).agg(F.min("chunk_id").alias("seed_chunk"))
    seeds = seeds.withColumn("nth", F.row_number().over(Window.partitionBy("request_id").orderBy("seed"))).filter(F.col("nth") <= limits.entities).drop("nth")
    first = met.withColumn("nth", F.row_number().over(by_entity)).filter(F.col("nth") <= limits.entities * limits.mentions_per_entity)
    spans = lambda *xs: F.array(*[F.struct(F.col(r).alias("revision"), F.col(a).alias("a"), F.col(b).alias("b")) for r, a, b in xs])
    ends = lambda *xs: F.array(*[F.struct(F.col(e).alias("entity"), F.col(r).alias("revision"), F.col("chunk_id").alias("chunk")) for e, r in xs])
    of_mentions = first.select(
        "request_id", F.lit("mention").alias("kind"), "nth", "revision_id", "entity_id", "chunk_id", "chunk_size", F.lit(None).cast("string").alias("seed_chunk"),
        ends(("entity_id", "revision_id")).alias("ends"), spans(("revision_id", "char_start", "char_end")).alias("evidence"),
    )
    # Of each entity, the first assertions that any request may take.
    touching = fits(assertions).withColumn("seed", F.explode(F.array_distinct(F.array_compact(F.array("subject_id", "object_id")))))
    touching = touching.withColumn("at", F.row_number().over(Window.partitionBy("seed").orderBy("revision_id"))).filter(F.col("at") <= limits.assertions)
    pairs = seeds.join(touching, "seed")
    one = Window.partitionBy("request_id", "revision_id").orderBy("seed", "seed_chunk")
    pairs = pairs.withColumn("nth", F.row_number().over(one)).filter("nth = 1").drop("nth")
    pairs = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("request_id").orderBy("revision_id"))).filter(F.col("nth") <= limits.assertions)
    entity = F.col("object_kind") == "entity"
    subject, both = ends(("subject_id", "subject_mention")), ends(("subject_id", "subject_mention"), ("object_id", "object_mention"))
    own, s, o = ("revision_id", "char_start", "char_end"), ("s_revision_id", "s_char_start", "s_char_end"), ("o_revision_id", "o_char_start", "o_char_end")
    of_assertions = pairs.select(
        "request_id", F.lit("assertion").alias("kind"), "nth", "revision_id", F.col("seed").alias("entity_id"), "chunk_id", "chunk_size", "seed_chunk",
        F.when(entity, both).otherwise(subject).alias("ends"), F.when(entity, spans(own, s, o)).otherwise(spans(own, s)).alias("evidence"),
    )

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["kind", "nth"], ascending=[False, True])  # mentions before assertions
        rows = [
            {"kind": r.kind, "seed": r.entity_id, "seed_chunk": r.seed_chunk, "chunk_id": r.chunk_id, "chunk_size": int(r.chunk_size),
             "ends": [(e["entity"], e["revision"], e["chunk"]) for e in r.ends], "evidence": [(e["revision"], int(e["a"]), int(e["b"])) for e in r.evidence]}
            for r in frame.itertuples()
        ]
        frame = frame.assign(decision=admit(rows, limits))
        kept = (frame["kind"] == "assertion") & (frame["decision"] == "admitted")
        return frame.assign(path=kept & (kept.cumsum() <= limits.paths))[["request_id", "kind", "revision_id", "entity_id", "chunk_id", "decision", "path"]]

    kinds = f"request_id {dict(requests.dtypes)['request_id']}, kind string, revision_id string, entity_id string, chunk_id string, decision string, path boolean"
    # A group has at most entities * mentions_per_entity + assertions rows, without texts.
    done = of_mentions.unionByName(of_assertions).groupBy("request_id").applyInPandas(decide, kinds)
    none = F.lit(None).cast("string")
    return done.unionByName(over.select(
        "request_id", F.lit("request").alias("kind"), none.alias("revision_id"), none.alias("entity_id"), none.alias("chunk_id"),
        F.lit("chunk_limit").alias("decision"), F.lit(False).alias("path")))
