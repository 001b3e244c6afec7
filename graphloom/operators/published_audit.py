"""Audit of a published graph: each revision, entity and endpoint against the publication's boundary and its ontology.

A publication is a set of tables. revisions: one row for each published revision of a mention or an assertion; members: the
publication's record kinds; heads: each record's current revision; chunks: the evidence, and whether its snapshot is active; links:
which entity stands at each role of a revision; projections: what the navigation graph shows of it; entities; and of the ontology
entity_types (name, namespaces), relation_types (name, source_type, target_type, source_required, source_single, target_required,
target_single) and property_types (entity_type, name, datatype, single_valued, required).

The checks of a revision go by what they need: conditions on the row and the ontology shuffle nothing, the others shuffle the few columns that
they compare. A rule can be asked for by itself, and reads its own tables alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.literals import canonical
from graphloom.staging import stage

#: The authority that each origin of knowledge has.
AUTHORITY = {
    "EXPERT_IMPORT": "AUTHORITATIVE", "EXPERT_CREATED": "AUTHORITATIVE", "LLM_EXTRACTED": "SECONDARY", "MAPPED": "SECONDARY",
    "AUTHORITATIVE_MAPPED": "AUTHORITATIVE", "AUTHORITATIVE_EXTRACTED": "AUTHORITATIVE", "HUMAN_SUPPLEMENT": "SECONDARY", "RULE_DERIVED": "SECONDARY",
}


@dataclass(frozen=True)
class Publication:
    """The boundary that all published rows must lie in."""

    tenant_id: str
    ontology_version: str


def _findings(rows: DataFrame, key: str, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """(code, severity, object_kind, object_id) for each rule whose condition does not hold, or is unknown, on a row."""
    name = lambda code, severity, kind: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(kind).alias("object_kind"))
    fails = [~F.coalesce(holds, F.lit(False)) for *_, holds in rules]
    broken = [F.when(fail, name(*rule)) for fail, (*rule, _) in zip(fails, rules, strict=True)]
    # Most rows break no rule: the array of what is broken, which is slow to make, is made of the others alone.
    each = rows.filter(reduce(or_, fails)).select(F.col(key).alias("object_id"), F.explode(F.array_compact(F.array(*broken))).alias("f"))
    return each.select("f.code", "f.severity", "f.object_kind", "object_id")


def _in_namespace(key: Column, namespaces: Column) -> Column:
    space = F.substring_index(key, ":", 1)
    return key.contains(":") & (F.length(key) > F.length(space) + 1) & F.array_contains(namespaces, F.lower(space))


#: Rules on one revision beside the ontology, and those that other tables of the publication decide; with the kind of object that each is about.
_ALL, _MENTION, _ASSERTION = "KnowledgeRevision", "EntityMentionRevision", "AssertionRevision"
REVISION_CODES = {
    "INVALID_REVISION_LABEL": _ALL, "REVISION_TENANT_MISMATCH": _ALL, "REVISION_TBOX_MISMATCH": _ALL, "REVISION_STATUS_INVALID": _ALL,
    "ORIGIN_AUTHORITY_INVALID": _ALL, "HEAD_CURRENT_REVISION_INVALID": _ALL, "PUBLICATION_RECORD_KIND_INVALID": _ALL, "EVIDENCE_ACTIVE_SNAPSHOT_INVALID": _ALL,
    "ENTITY_TYPE_UNDECLARED": _MENTION, "ENTITY_NAMESPACE_INVALID": _MENTION, "MENTION_ENTITY_LINK_INVALID": _MENTION,
    "ACTIVE_MENTION_MATERIALIZATION_INVALID": _MENTION, "ACTIVE_MENTION_PROJECTION_INVALID": _MENTION,
    "ACTIVE_ASSERTION_MATERIALIZATION_INVALID": _ASSERTION, "ACTIVE_ASSERTION_PROJECTION_INVALID": _ASSERTION, "ASSERTION_SUBJECT_SCHEMA_INVALID": _ASSERTION,
    "SUBJECT_MENTION_LINK_INVALID": _ASSERTION, "RELATIONSHIP_PATTERN_INVALID": _ASSERTION, "OBJECT_MENTION_LINK_INVALID": _ASSERTION,
    "TYPED_LITERAL_INVALID": _ASSERTION, "ASSERTION_OBJECT_KIND_INVALID": _ASSERTION,
}


def _fails(rows: DataFrame, rules: list[tuple[str, Column]], codes: set[str]) -> DataFrame | None:
    rules = [(code, "ERROR", REVISION_CODES[code], holds) for code, holds in rules if code in codes]
    return _findings(rows, "revision_id", rules) if rules else None


def _only(when: Column, holds: Column) -> Column:
    return ~F.coalesce(when, F.lit(False)) | F.coalesce(holds, F.lit(False))


def _is(kind: str, of: str | None = None) -> Column:
    found = F.col("kind") == kind
    return found if of is None else found & (F.col("object_kind") == of)


def _alone(t: dict[str, DataFrame], publication: Publication, codes: set[str]) -> DataFrame | None:
    """Rules on a revision and the ontology, which is small: it is broadcast, so no revision is shuffled (nor all of a type into one task)."""
    authority = F.create_map(*[F.lit(x) for pair in AUTHORITY.items() for x in pair])
    mention, assertion, entity, literal = _is("ENTITY_MENTION"), _is("ASSERTION"), _is("ASSERTION", "entity"), _is("ASSERTION", "literal")
    typed = lambda x: F.broadcast(t["entity_types"].select(F.col("name").alias(f"{x}_name"), F.col("namespaces").alias(f"{x}_spaces")))
    patterns = F.broadcast(t["relation_types"].select(F.col("name").alias("r_name"), F.col("source_type").alias("r_source"), F.col("target_type").alias("r_target")))
    literals = F.broadcast(t["property_types"].select(F.col("entity_type").alias("p_type"), F.col("name").alias("p_name"), "datatype"))
    rows = (
        t["revisions"].join(typed("e"), F.col("entity_type") == F.col("e_name"), "left").join(typed("s"), F.col("subject_type") == F.col("s_name"), "left")
        .join(typed("o"), F.col("object_type") == F.col("o_name"), "left")
        .join(patterns, (F.col("predicate") == F.col("r_name")) & (F.col("subject_type") == F.col("r_source")) & (F.col("object_type") == F.col("r_target")), "left")
        .join(literals, (F.col("subject_type") == F.col("p_type")) & (F.col("predicate") == F.col("p_name")), "left")
    )
    return _fails(rows, [
        ("INVALID_REVISION_LABEL", F.col("kind").isin("ENTITY_MENTION", "ASSERTION")),
        ("REVISION_TENANT_MISMATCH", F.col("tenant_id") == publication.tenant_id),
        ("REVISION_TBOX_MISMATCH", F.col("ontology_version") == publication.ontology_version),
        ("REVISION_STATUS_INVALID", F.col("status") == "PUBLISHED"),
        ("ORIGIN_AUTHORITY_INVALID", F.col("authority") == authority[F.col("origin")]),
        ("ENTITY_TYPE_UNDECLARED", _only(mention, F.col("e_name").isNotNull())),
        ("ENTITY_NAMESPACE_INVALID", _only(mention, _in_namespace(F.col("canonical_key"), F.col("e_spaces")))),
        ("ASSERTION_SUBJECT_SCHEMA_INVALID", _only(assertion, _in_namespace(F.col("subject_key"), F.col("s_spaces")))),
        ("RELATIONSHIP_PATTERN_INVALID", _only(entity, F.col("r_name").isNotNull() & _in_namespace(F.col("object_key"), F.col("o_spaces")))),
        ("TYPED_LITERAL_INVALID", _only(literal, F.col("p_name").isNotNull() & (canonical(F.col("value"), F.col("datatype")) == F.col("canonical_value")) & F.col("object_id").isNull())),
        ("ASSERTION_OBJECT_KIND_INVALID", _only(assertion, F.col("object_kind").isin("entity", "literal"))),
    ], codes)


def _headed(t: dict[str, DataFrame], publication: Publication, codes: set[str]) -> DataFrame | None:
    """The rule on a revision's head; heads meet their revisions as they are and are counted there."""
    heads = t["heads"].select(F.col("record_id").alias("h_record"), F.col("tenant_id").alias("h_tenant"), F.col("record_kind").alias("h_kind"), "current_revision", F.lit(1).alias("h"))
    own = t["revisions"].select("revision_id", "record_id", "kind", "revision")
    fits = (F.col("h_tenant") == publication.tenant_id) & (F.col("h_kind") == F.col("kind")) & (F.col("current_revision") >= F.col("revision"))
    met = own.join(heads, F.col("record_id") == F.col("h_record"), "left").groupBy("record_id", "revision_id").agg(
        F.count("h").alias("n"), F.bool_and(F.coalesce(fits, F.lit(False))).alias("fits"))
    return _fails(met, [("HEAD_CURRENT_REVISION_INVALID", (F.col("n") == 1) & F.col("fits"))], codes)


def _evidenced(t: dict[str, DataFrame], codes: set[str]) -> DataFrame | None:
    """The rule on a revision's evidence: the chunks that may be evidence are stored, so that few of them are broadcast."""
    if "EVIDENCE_ACTIVE_SNAPSHOT_INVALID" not in codes:
        return None
    chunks = t["chunks"].groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("active").alias("active"))
    sound = stage(chunks.filter("n = 1 AND active").select("chunk_id"), "sound-chunks")
    without = t["revisions"].select("revision_id", "chunk_id").join(sound, "chunk_id", "left_anti")
    return _fails(without, [("EVIDENCE_ACTIVE_SNAPSHOT_INVALID", F.lit(False))], codes)


def _matched(t: dict[str, DataFrame], publication: Publication, codes: set[str]) -> DataFrame | None:
    """Rules on a revision's members, links and projections, and on the mentions that an assertion names for its ends.

    What other tables say of a revision meets it in one join, row by row, and is counted and compared there: nothing is sorted or grouped
    before, and the revision is shuffled once for all of them.
    """
    uses = {  # what: rules that need it
        "member": ("PUBLICATION_RECORD_KIND_INVALID",), "entity": ("MENTION_ENTITY_LINK_INVALID",), "subject": ("SUBJECT_MENTION_LINK_INVALID",), "object": ("OBJECT_MENTION_LINK_INVALID",),
        "shown": ("ACTIVE_MENTION_MATERIALIZATION_INVALID", "ACTIVE_MENTION_PROJECTION_INVALID", "ACTIVE_ASSERTION_MATERIALIZATION_INVALID", "ACTIVE_ASSERTION_PROJECTION_INVALID"),
    }
    asked = [what for what, rules in uses.items() if codes & {*rules}]
    if not asked:
        return None
    place = {what: k for k, what in enumerate((*uses, "lone subject", "lone object"))}
    of = {"member": F.lit(True), "entity": _is("ENTITY_MENTION"), "subject": _is("ASSERTION"), "object": _is("ASSERTION", "entity"), "shown": F.col("kind").isin("ENTITY_MENTION", "ASSERTION")}
    row = lambda rows, at, v, v_type, inside: rows.select("revision_id", at.cast("int").alias("at"), v.alias("v"), v_type.alias("v_type"), inside.alias("inside"))
    nothing, roles = F.lit(""), [x for x in asked if x not in ("member", "shown")]
    here = []
    if "member" in asked:
        here.append(row(t["members"], F.lit(place["member"]), F.col("record_kind"), nothing, F.lit(True)))
    if "shown" in asked:
        here.append(row(t["projections"], F.lit(place["shown"]), F.col("payload"), nothing, F.lit(True)))
    if roles:
        number = F.lit(None)
        for x in roles:
            number = F.when(F.col("role") == x, place[x]).otherwise(number)
        inside = F.coalesce(F.col("tenant_id") == publication.tenant_id, F.lit(False))
        here.append(row(t["links"].filter(F.col("role").isin(roles)), number, F.col("entity_id"), F.col("entity_type"), inside))
    # An assertion's ends of which no mention of this publication says the same: keyed by mention and entity, so one mention that many name is dealt to many tasks.
    ends = [x for x in roles if x != "entity"]
    mentions = t["revisions"].filter(_is("ENTITY_MENTION")).select(F.col("revision_id").alias("mention"), F.col("entity_id").alias("named"))
    for x in ends:
        named = t["revisions"].filter(of[x]).select("revision_id", F.col(f"{x}_mention").alias("mention"), F.col(f"{x}_id").alias("named"))
        here.append(row(named.join(mentions, ["mention", "named"], "left_anti"), F.lit(place[f"lone {x}"]), nothing, nothing, F.lit(True)))
    own, own_type, concerned = F.lit(None).cast("string"), nothing, F.lit(False)
    for x, v in (("member", F.col("kind")), ("shown", F.col("payload")), *((x, F.col("entity_id" if x == "entity" else f"{x}_id")) for x in roles)):
        if x in asked:
            own, concerned = F.when(F.col("at") == place[x], v).otherwise(own), concerned | of[x]
    for x in roles:
        own_type = F.when(F.col("at") == place[x], F.col(f"{x}_type")).otherwise(own_type)
    fits = F.coalesce((F.col("v") == own) & (F.col("v_type") == own_type) & F.col("inside"), F.lit(False))
    met = t["revisions"].filter(concerned).join(reduce(DataFrame.unionByName, here), "revision_id", "left").select(  # the others have no rule to break
        "revision_id", "kind", "object_kind", "at", F.when(~fits, F.expr("shiftleft(1, at)")).otherwise(0).alias("unlike"))
    met = met.groupBy("revision_id", "kind", "object_kind").agg(
        F.bit_or("unlike").alias("unlike"), *[F.count_if(F.col("at") == place[x]).alias(f"n_{x}") for x in (*asked, *(f"lone {x}" for x in ends))])
    once = lambda x: F.col(f"n_{x}") == 1 if x in asked else F.lit(True)
    right = lambda x: once(x) & (F.col("unlike").bitwiseAND(1 << place[x]) == 0)
    said = lambda x: right(x) & (F.col(f"n_lone {x}") == 0) if x in asked else F.lit(True)
    return _fails(met, [
        ("PUBLICATION_RECORD_KIND_INVALID", right("member")), ("MENTION_ENTITY_LINK_INVALID", _only(of["entity"], right("entity"))),
        ("ACTIVE_MENTION_MATERIALIZATION_INVALID", _only(of["entity"], once("shown"))), ("ACTIVE_MENTION_PROJECTION_INVALID", _only(of["entity"], right("shown"))),
        ("ACTIVE_ASSERTION_MATERIALIZATION_INVALID", _only(of["subject"], once("shown"))), ("ACTIVE_ASSERTION_PROJECTION_INVALID", _only(of["subject"], right("shown"))),
        ("SUBJECT_MENTION_LINK_INVALID", _only(of["subject"], said("subject"))), ("OBJECT_MENTION_LINK_INVALID", _only(of["object"], said("object"))),
    ], codes)


def revision_findings(t: dict[str, DataFrame], publication: Publication, codes: Iterable[str] = REVISION_CODES) -> DataFrame:
    """What is wrong with published revisions by the rules ``codes``: (code, severity, object_kind, object_id). Tables that no such rule needs are not read."""
    codes = {*codes}
    if unknown := codes - REVISION_CODES.keys():
        raise ValueError(f"unknown rules {sorted(unknown)}")
    parts = [_alone(t, publication, codes), _headed(t, publication, codes), _evidenced(t, codes), _matched(t, publication, codes)]
    found = None
    for part in parts:
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no rules")
    return found


def entity_findings(t: dict[str, DataFrame], publication: Publication, hub_degree: int = 1000) -> DataFrame:
    """What is wrong with published entities; a degree that reaches ``hub_degree`` is to be reviewed."""
    mentions = t["revisions"].filter("kind = 'ENTITY_MENTION'").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_mentions"))
    ends = t["revisions"].filter("kind = 'ASSERTION'").select(
        "revision_id", F.explode(F.array_distinct(F.array_compact(F.array("subject_id", "object_id")))).alias("entity_id")
    )
    degree = ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))  # a row of revisions is one revision, and names an end once
    active = t["active_entities"].select("entity_id").distinct().withColumn("is_active", F.lit(True))
    spaces = F.broadcast(t["entity_types"].select(F.col("name").alias("e_name"), F.col("namespaces").alias("e_spaces")))
    twins = t["entities"].groupBy(F.lower("entity_type").alias("d_type"), F.lower("canonical_key").alias("d_key")).agg(F.count_distinct("entity_id").alias("n_same"))
    rows = (
        t["entities"].join(mentions, "entity_id", "left").join(degree, "entity_id", "left").join(active, "entity_id", "left")
        .join(spaces, F.col("entity_type") == F.col("e_name"), "left")
        .join(twins, (F.lower("entity_type") == F.col("d_type")) & (F.lower("canonical_key") == F.col("d_key")), "left")
    )
    n = F.coalesce("degree", F.lit(0))
    lawful = (F.col("tenant_id") == publication.tenant_id) & _in_namespace(F.col("canonical_key"), F.col("e_spaces"))
    return _findings(rows, "entity_id", [
        ("CANONICAL_ENTITY_SCHEMA_INVALID", "ERROR", "Entity", lawful), ("ORPHAN_ENTITY", "ERROR", "Entity", F.col("n_mentions") > 0),
        ("ACTIVE_ENTITY_MEMBERSHIP_MISSING", "ERROR", "Entity", F.col("is_active")), ("ISOLATED_ENTITY", "WARNING", "Entity", n > 0),
        ("ANOMALOUS_HUB", "REVIEW", "Entity", n < hub_degree), ("DUPLICATE_ENTITY", "ERROR", "Entity", F.col("n_same") == 1),
    ])


def endpoint_findings(t: dict[str, DataFrame]) -> DataFrame:
    """Entities whose number of different partners breaks the cardinality of a relation at its source or its target."""
    entities = t["entities"].select("entity_id", "entity_type")
    pairs = t["revisions"].filter("kind = 'ASSERTION' AND object_kind = 'entity'").select("predicate", "subject_id", "object_id").distinct()
    out = None
    for end, own, other in (("source", "subject_id", "object_id"), ("target", "object_id", "subject_id")):
        rules = t["relation_types"].select(
            F.col("name").alias("relation"), F.col(f"{end}_type").alias("rule_type"), F.col(f"{end}_required").alias("required"), F.col(f"{end}_single").alias("single"),
            "source_type", "target_type",
        )
        kinds = lambda x, name: entities.select(F.col("entity_id").alias(x), F.col("entity_type").alias(name))
        typed = pairs.join(kinds("subject_id", "s_type"), "subject_id").join(kinds("object_id", "o_type"), "object_id")
        fit = typed.join(F.broadcast(rules.select("relation", "source_type", "target_type")), (F.col("predicate") == F.col("relation")) & (F.col("s_type") == F.col("source_type")) & (F.col("o_type") == F.col("target_type")))
        counts = fit.groupBy(F.col("relation").alias("c_relation"), F.col(own).alias("c_id")).agg(F.count_distinct(other).alias("n"))
        bound = entities.join(F.broadcast(rules), F.col("entity_type") == F.col("rule_type")).join(
            counts, (F.col("relation") == F.col("c_relation")) & (F.col("entity_id") == F.col("c_id")), "left"
        )
        n = F.coalesce("n", F.lit(0))
        bad = bound.filter((F.col("required") & (n == 0)) | (F.col("single") & (n > 1)))
        one = bad.select(
            F.lit("RELATIONSHIP_ENDPOINT_CARDINALITY_INVALID").alias("code"), F.lit("ERROR").alias("severity"), F.lit("Entity").alias("object_kind"),
            F.col("entity_id").alias("object_id"), F.concat("relation", F.lit(f" {end}")).alias("detail"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def property_findings(t: dict[str, DataFrame]) -> DataFrame:
    """Entities that lack a required property or have several meanings of a single-valued one."""
    facts = t["revisions"].filter("kind = 'ASSERTION' AND object_kind = 'literal'").groupBy(F.col("subject_id").alias("f_id"), F.col("predicate").alias("f_name")).agg(
        F.count_distinct("canonical_value").alias("n")
    )
    bound = t["entities"].join(F.broadcast(t["property_types"].withColumnRenamed("entity_type", "p_type").withColumnRenamed("name", "p_name")), F.col("entity_type") == F.col("p_type"))
    counted = bound.join(facts, (F.col("entity_id") == F.col("f_id")) & (F.col("p_name") == F.col("f_name")), "left")
    n = F.coalesce("n", F.lit(0))
    code = F.when(F.col("required") & (n == 0), "REQUIRED_ENTITY_PROPERTY_MISSING").when(F.col("single_valued") & (n > 1), "ENTITY_PROPERTY_CARDINALITY_INVALID")
    return counted.select(code.alias("code"), F.lit("ERROR").alias("severity"), F.lit("Entity").alias("object_kind"), F.col("entity_id").alias("object_id"), F.col("p_name").alias("detail")).filter("code IS NOT NULL")


def report(findings: DataFrame, run: str, most: int) -> DataFrame:
    """The first ``most`` findings by (code, object) with their issue ids, and on each the totals of the whole audit.

    Totals are counted over all findings, so a report that was cut says so (``truncated``).
    """
    key = F.concat_ws("|", F.lit(run), "code", "severity", "object_kind", "object_id")
    totals = findings.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "ERROR").alias("errors"))
    first = findings.orderBy("code", "object_kind", "object_id").limit(most)
    return first.crossJoin(F.broadcast(totals)).select(  # one row of totals
        F.concat(F.lit("published-quality-issue:"), F.sha2(key, 256)).alias("issue_id"), "code", "severity", "object_kind", "object_id", "total", "errors",
        (F.col("total") > most).alias("truncated"),
    )


def review_sample(findings: DataFrame, evidence: DataFrame, run: str, most: int) -> DataFrame:
    """(object_kind, object_id, codes, chunks): the objects of smallest hash, their codes and their three first evidence chunks (object_id, chunk_id)."""
    objects = findings.select("object_kind", "object_id").distinct()
    first = objects.withColumn("h", F.sha2(F.concat_ws("|", F.lit(run), "object_kind", "object_id"), 256)).orderBy("h", "object_kind", "object_id").limit(most)
    first = stage(first.select("object_kind", "object_id"), "audit-sample")
    # Only the sample's few objects meet their findings and their evidence.
    hashed = findings.join(F.broadcast(first), ["object_kind", "object_id"]).groupBy("object_kind", "object_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    nth = F.row_number().over(Window.partitionBy("object_id").orderBy("chunk_id"))
    chunks = evidence.join(F.broadcast(first.select("object_id").distinct()), "object_id").distinct().withColumn("nth", nth).filter("nth <= 3")
    listed = chunks.groupBy("object_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunks"))
    return hashed.join(listed, "object_id", "left").select("object_kind", "object_id", "codes", F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"))


def compared(before: DataFrame, now: DataFrame) -> DataFrame:
    """(code, object_kind, object_id, state) of two runs' findings: NEW, PERSISTING or RESOLVED."""
    keys = ["code", "object_kind", "object_id"]
    side = lambda rows, x: rows.select(*keys).distinct().withColumn(x, F.lit(True))
    both = side(before, "was").join(side(now, "is"), keys, "full")
    return both.select(*keys, F.when(F.col("was").isNull(), "NEW").when(F.col("is").isNull(), "RESOLVED").otherwise("PERSISTING").alias("state"))


def decided(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """``findings`` with ``decision``: the last one (by decided_at) on each (code, object_id), null where nobody has decided."""
    last = decisions.groupBy("code", "object_id").agg(F.max_by("decision", "decided_at").alias("decision"))
    return findings.join(last, ["code", "object_id"], "left")
