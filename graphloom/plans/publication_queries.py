"""A published graph with planted faults, derived from suppliers, parts and lines, and its audit.

The tables are given in SQL that Spark and DuckDB both read, so that both sides start from the same rows; the rules are each side's own.
A row's number ``n`` modulo a prime decides whether, and how, it is damaged.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import published_audit as audit
from graphloom.plans.registry import query
from graphloom.sources.tables import load
from graphloom.staging import kept, stage
from graphloom.store import table_version

PUBLICATION, HUB = audit.Publication("t0", "ontology-3"), 560

_FACTS = "(SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM {lineitem})"
_RAW = f"""SELECT concat('m-s', s_suppkey) AS revision_id, 'ENTITY_MENTION' AS base, s_suppkey AS n, concat('s', s_suppkey) AS entity_id, 'Supplier' AS base_type, concat('supplier-id:', s_suppkey) AS base_key,
    NULL AS subject_id, NULL AS subject_type, NULL AS subject_key, NULL AS base_subject_mention, NULL AS base_predicate, NULL AS base_object_kind, NULL AS object_id, NULL AS object_type, NULL AS object_key, NULL AS base_object_mention, NULL AS base_value FROM {{supplier}}
  UNION ALL SELECT concat('m-p', p_partkey), 'ENTITY_MENTION', p_partkey, concat('p', p_partkey), 'Part', concat('part-id:', p_partkey), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {{part}}
  UNION ALL SELECT concat('a-', s, '-', p), 'ASSERTION', s * 7 + p, NULL, NULL, NULL, concat('s', s), 'Supplier', concat('supplier-id:', s), concat('m-s', s), 'SUPPLIES', 'entity', concat('p', p), 'Part', concat('part-id:', p), concat('m-p', p), NULL FROM {_FACTS} f
  UNION ALL SELECT concat('l-', p_partkey), 'ASSERTION', p_partkey, NULL, NULL, NULL, concat('p', p_partkey), 'Part', concat('part-id:', p_partkey), concat('m-p', p_partkey), 'Size', 'literal', NULL, NULL, NULL, NULL, concat('', p_size) FROM {{part}}"""
#: (name, SQL): the published tables, each made from the supplied ones and those before it.
TABLES = (
    ("raw", _RAW),
    ("revisions", """SELECT revision_id, concat('record-', revision_id) AS record_id, CASE WHEN n % 101 = 1 THEN 't9' ELSE 't0' END AS tenant_id, CASE WHEN n % 101 = 2 THEN 'ontology-2' ELSE 'ontology-3' END AS ontology_version,
  CASE WHEN n % 101 = 3 THEN 'APPROVED' ELSE 'PUBLISHED' END AS status, CASE WHEN n % 3 = 0 THEN 'MAPPED' ELSE 'EXPERT_IMPORT' END AS origin,
  CASE WHEN n % 3 = 0 AND n % 101 <> 4 THEN 'SECONDARY' ELSE 'AUTHORITATIVE' END AS authority, CASE WHEN n % 101 = 5 THEN 'UNKNOWN' ELSE base END AS kind, CAST(1 + n % 4 AS INT) AS revision, concat('chunk-', n % 500) AS chunk_id,
  entity_id, CASE WHEN n % 101 = 9 AND base = 'ENTITY_MENTION' THEN 'Widget' ELSE base_type END AS entity_type, CASE WHEN n % 101 = 10 THEN 'other-id:1' WHEN n % 101 = 11 THEN 'part-id:' ELSE base_key END AS canonical_key,
  subject_id, subject_type, subject_key, CASE WHEN n % 101 = 16 THEN 'm-s1' ELSE base_subject_mention END AS subject_mention,
  CASE WHEN n % 101 = 15 THEN 'SUPPLIED_BY' WHEN n % 101 = 19 AND base_predicate = 'Size' THEN 'Width' ELSE base_predicate END AS predicate, CASE WHEN n % 101 = 14 THEN 'thing' ELSE base_object_kind END AS object_kind,
  object_id, object_type, object_key, CASE WHEN n % 101 = 17 THEN NULL ELSE base_object_mention END AS object_mention, CASE WHEN n % 101 = 18 THEN concat(' ', base_value) ELSE base_value END AS value, base_value AS canonical_value,
  concat(revision_id, '#', 1 + n % 4) AS payload, n FROM {raw}"""),
    ("members", "SELECT revision_id, CASE WHEN n % 103 = 1 THEN 'OTHER' ELSE kind END AS record_kind FROM {revisions} UNION ALL SELECT revision_id, kind FROM {revisions} WHERE n % 103 = 2"),
    ("heads", "SELECT record_id, CASE WHEN n % 103 = 5 THEN 't9' ELSE 't0' END AS tenant_id, kind AS record_kind, CASE WHEN n % 103 = 3 THEN revision - 1 ELSE revision END AS current_revision FROM {revisions} WHERE n % 103 <> 4"),
    ("chunks", "SELECT DISTINCT chunk_id, n % 500 <> 77 AS active FROM {revisions} WHERE n % 500 <> 78"),
    ("links", """SELECT revision_id, 'entity' AS role, CASE WHEN n % 107 = 1 THEN 's1' ELSE entity_id END AS entity_id, entity_type, 't0' AS tenant_id FROM {revisions} WHERE entity_id IS NOT NULL AND n % 107 <> 2
  UNION ALL SELECT revision_id, 'subject', subject_id, subject_type, CASE WHEN n % 107 = 3 THEN 't9' ELSE 't0' END FROM {revisions} WHERE subject_id IS NOT NULL
  UNION ALL SELECT revision_id, 'object', object_id, CASE WHEN n % 107 = 4 THEN 'Supplier' ELSE object_type END, 't0' FROM {revisions} WHERE object_id IS NOT NULL
  UNION ALL SELECT revision_id, 'object', object_id, object_type, 't0' FROM {revisions} WHERE object_id IS NOT NULL AND n % 107 = 5"""),
    ("projections", "SELECT revision_id, CASE WHEN n % 109 = 1 THEN 'stale' ELSE payload END AS payload FROM {revisions} WHERE n % 109 <> 2 UNION ALL SELECT revision_id, payload FROM {revisions} WHERE n % 109 = 3"),
    ("entities", """SELECT concat('s', s_suppkey) AS entity_id, 'Supplier' AS entity_type, concat('supplier-id:', s_suppkey) AS canonical_key, CASE WHEN s_suppkey % 23 = 5 THEN 't9' ELSE 't0' END AS tenant_id FROM {supplier}
  UNION ALL SELECT concat('p', p_partkey), 'Part', CASE WHEN p_partkey % 113 = 1 THEN concat('PART-ID:', p_partkey + 1) WHEN p_partkey % 113 = 3 THEN 'loose' ELSE concat('part-id:', p_partkey) END, 't0' FROM {part}
  UNION ALL SELECT concat('x', n_nationkey), 'Supplier', concat('supplier-id:x', n_nationkey), 't0' FROM {nation}"""),
    ("active_entities", "SELECT entity_id FROM {entities} WHERE entity_id NOT LIKE '%7'"),
)
ENTITY_TYPES = [("Supplier", ["supplier-id"]), ("Part", ["part-id", "sku"])]
RELATIONS = [("SUPPLIES", "Supplier", "Part", True, False, False, False), ("MAIN_PART", "Part", "Supplier", False, True, False, True)]
PROPERTIES = [("Part", "Size", "INTEGER", True, True), ("Supplier", "Rating", "INTEGER", True, False)]
SUPPLIED = ("supplier", "part", "lineitem", "nation")


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    return (spark.sparkContext.applicationId, sf_dir, *(table_version(load(spark, sf_dir, t)) for t in SUPPLIED))


def published(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The published tables and the ontology's."""
    t = {name: load(spark, sf_dir, name) for name in SUPPLIED}
    # Every table is a projection of the distinct facts: these two numbers a row are stored, the texts made of them are not.
    t["facts"] = kept(("facts", *_state(spark, sf_dir)), lambda: stage(spark.sql(_FACTS.strip("()"), lineitem=t["lineitem"]), "facts"))
    for name, sql in TABLES:
        sql = sql.replace(_FACTS, "{facts}")
        t[name] = spark.sql(sql, **{k: v for k, v in t.items() if "{" + k + "}" in sql})
    return t | {
        "entity_types": spark.createDataFrame(ENTITY_TYPES, "name string, namespaces array<string>"),
        "relation_types": spark.createDataFrame(RELATIONS, "name string, source_type string, target_type string, source_required boolean, source_single boolean, target_required boolean, target_single boolean"),
        "property_types": spark.createDataFrame(PROPERTIES, "entity_type string, name string, datatype string, single_valued boolean, required boolean"),
    }


def _duck(sql: str) -> str:
    for name in (*SUPPLIED, *(n for n, _ in TABLES)):
        sql = sql.replace("{" + name + "}", name)
    return sql


BASE = ",\n".join(f"{name} AS ({_duck(sql)})" for name, sql in TABLES)
_SPACE = "(contains({0}, ':') AND length({0}) > length(split_part({0}, ':', 1)) + 1 AND list_contains({1}, lower(split_part({0}, ':', 1))))"
_LINKED = "(SELECT count(*) = 1 AND bool_and(l.entity_id = r.{1} AND l.entity_type = r.{2} AND l.tenant_id = 't0') FROM links l WHERE l.revision_id = r.revision_id AND l.role = '{0}')"
_TYPES = "MAP {'Supplier': ['supplier-id'], 'Part': ['part-id', 'sku']}"
_M, _A = "r.kind = 'ENTITY_MENTION'", "r.kind = 'ASSERTION'"
_E, _L = "r.kind = 'ASSERTION' AND r.object_kind = 'entity'", "r.kind = 'ASSERTION' AND r.object_kind = 'literal'"
_SHOWN = "(SELECT count(*) FROM projections p WHERE p.revision_id = r.revision_id)"
_SAME = "(SELECT max(p.payload) FROM projections p WHERE p.revision_id = r.revision_id)"
#: (code, object kind, where the rule applies, what must hold) in DuckDB's SQL, over revisions r.
REVISION_RULES = (
    ("INVALID_REVISION_LABEL", "KnowledgeRevision", "true", "r.kind IN ('ENTITY_MENTION', 'ASSERTION')"),
    ("REVISION_TENANT_MISMATCH", "KnowledgeRevision", "true", "r.tenant_id = 't0'"),
    ("REVISION_TBOX_MISMATCH", "KnowledgeRevision", "true", "r.ontology_version = 'ontology-3'"),
    ("REVISION_STATUS_INVALID", "KnowledgeRevision", "true", "r.status = 'PUBLISHED'"),
    ("ORIGIN_AUTHORITY_INVALID", "KnowledgeRevision", "true", "r.authority = CASE r.origin WHEN 'MAPPED' THEN 'SECONDARY' WHEN 'EXPERT_IMPORT' THEN 'AUTHORITATIVE' END"),
    ("HEAD_CURRENT_REVISION_INVALID", "KnowledgeRevision", "true", "(SELECT count(*) = 1 AND bool_and(h.tenant_id = 't0' AND h.record_kind = r.kind AND h.current_revision >= r.revision) FROM heads h WHERE h.record_id = r.record_id)"),
    ("PUBLICATION_RECORD_KIND_INVALID", "KnowledgeRevision", "true", "(SELECT count(*) = 1 AND bool_and(m.record_kind = r.kind) FROM members m WHERE m.revision_id = r.revision_id)"),
    ("EVIDENCE_ACTIVE_SNAPSHOT_INVALID", "KnowledgeRevision", "true", "(SELECT count(*) = 1 AND bool_and(c.active) FROM chunks c WHERE c.chunk_id = r.chunk_id)"),
    ("ENTITY_TYPE_UNDECLARED", "EntityMentionRevision", _M, "r.entity_type IN ('Supplier', 'Part')"),
    ("ENTITY_NAMESPACE_INVALID", "EntityMentionRevision", _M, _SPACE.format("r.canonical_key", f"{_TYPES}[r.entity_type]")),
    ("MENTION_ENTITY_LINK_INVALID", "EntityMentionRevision", _M, _LINKED.format("entity", "entity_id", "entity_type")),
    ("ACTIVE_MENTION_MATERIALIZATION_INVALID", "EntityMentionRevision", _M, f"{_SHOWN} = 1"),
    ("ACTIVE_MENTION_PROJECTION_INVALID", "EntityMentionRevision", _M, f"{_SHOWN} = 1 AND {_SAME} = r.payload"),
    ("ACTIVE_ASSERTION_MATERIALIZATION_INVALID", "AssertionRevision", _A, f"{_SHOWN} = 1"),
    ("ACTIVE_ASSERTION_PROJECTION_INVALID", "AssertionRevision", _A, f"{_SHOWN} = 1 AND {_SAME} = r.payload"),
    ("ASSERTION_SUBJECT_SCHEMA_INVALID", "AssertionRevision", _A, _SPACE.format("r.subject_key", f"{_TYPES}[r.subject_type]")),
    ("SUBJECT_MENTION_LINK_INVALID", "AssertionRevision", _A, _LINKED.format("subject", "subject_id", "subject_type") + " AND EXISTS (FROM revisions m WHERE m.kind = 'ENTITY_MENTION' AND m.revision_id = r.subject_mention AND m.entity_id = r.subject_id)"),
    ("RELATIONSHIP_PATTERN_INVALID", "AssertionRevision", _E, "r.predicate = 'SUPPLIES' AND r.subject_type = 'Supplier' AND r.object_type = 'Part' AND " + _SPACE.format("r.object_key", f"{_TYPES}[r.object_type]")),
    ("OBJECT_MENTION_LINK_INVALID", "AssertionRevision", _E, _LINKED.format("object", "object_id", "object_type") + " AND EXISTS (FROM revisions m WHERE m.kind = 'ENTITY_MENTION' AND m.revision_id = r.object_mention AND m.entity_id = r.object_id)"),
    ("TYPED_LITERAL_INVALID", "AssertionRevision", _L, "r.predicate = 'Size' AND r.subject_type = 'Part' AND regexp_full_match(r.value, '[+-]?(0|[1-9][0-9]*)') AND r.value = r.canonical_value AND r.object_id IS NULL"),
    ("ASSERTION_OBJECT_KIND_INVALID", "AssertionRevision", _A, "r.object_kind IN ('entity', 'literal')"),
)
REVISIONS_SQL = "\nUNION ALL ".join(
    f"SELECT '{code}' AS code, 'ERROR' AS severity, '{kind}' AS object_kind, revision_id AS object_id FROM revisions r WHERE ({when}) AND NOT coalesce({holds}, false)" for code, kind, when, holds in REVISION_RULES
)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of one audit of all revisions: stored, once in an application and state of the tables, for all that look at them."""
    return kept(("audit", *_state(spark, sf_dir)), lambda: stage(audit.revision_findings(published(spark, sf_dir), PUBLICATION), "audit-run"))


def _by_code(code: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.revision_findings(published(spark, sf_dir), PUBLICATION, [code])


@query(f"WITH {BASE}, found AS ({REVISIONS_SQL}) SELECT code, severity, object_kind, count(*) AS n, min(object_id) AS first_id, max(object_id) AS last_id FROM found GROUP BY ALL")
def audit_revision_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many revisions break each rule."""
    return _run(spark, sf_dir).groupBy("code", "severity", "object_kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("object_id").alias("first_id"), F.max("object_id").alias("last_id")
    )


for _code, _kind, _when, _holds in REVISION_RULES:
    _one = partial(_by_code, _code)
    _one.__name__ = f"audit_{_code.lower()}"
    _one.__doc__ = f"Revisions with {_code}."
    query(f"WITH {BASE} SELECT '{_code}' AS code, 'ERROR' AS severity, '{_kind}' AS object_kind, revision_id AS object_id FROM revisions r WHERE ({_when}) AND NOT coalesce({_holds}, false)")(_one)

_ENTITIES_SQL = f"""ends AS (SELECT subject_id AS e, revision_id FROM revisions WHERE kind = 'ASSERTION' UNION SELECT object_id, revision_id FROM revisions WHERE kind = 'ASSERTION'),
x AS (SELECT e.*, (SELECT count(*) FROM revisions m WHERE m.kind = 'ENTITY_MENTION' AND m.entity_id = e.entity_id) AS mentions, (SELECT count(*) FROM ends WHERE ends.e = e.entity_id) AS degree,
  e.entity_id IN (SELECT entity_id FROM active_entities) AS active, (SELECT count(DISTINCT o.entity_id) FROM entities o WHERE o.entity_type = e.entity_type AND lower(o.canonical_key) = lower(e.canonical_key)) AS same FROM entities e),
entity_found AS (SELECT 'CANONICAL_ENTITY_SCHEMA_INVALID' AS code, 'ERROR' AS severity, entity_id FROM x WHERE NOT coalesce(tenant_id = 't0' AND {_SPACE.format('canonical_key', _TYPES + '[entity_type]')}, false)
  UNION ALL SELECT 'ORPHAN_ENTITY', 'ERROR', entity_id FROM x WHERE mentions = 0 UNION ALL SELECT 'ACTIVE_ENTITY_MEMBERSHIP_MISSING', 'ERROR', entity_id FROM x WHERE NOT active
  UNION ALL SELECT 'ISOLATED_ENTITY', 'WARNING', entity_id FROM x WHERE degree = 0 UNION ALL SELECT 'ANOMALOUS_HUB', 'REVIEW', entity_id FROM x WHERE degree >= {HUB}
  UNION ALL SELECT 'DUPLICATE_ENTITY', 'ERROR', entity_id FROM x WHERE same > 1)"""


@query(f"WITH {BASE}, {_ENTITIES_SQL} SELECT code, severity, 'Entity' AS object_kind, entity_id AS object_id FROM entity_found")
def audit_published_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.entity_findings(published(spark, sf_dir), PUBLICATION, HUB)


@query(f"""WITH {BASE}, pairs AS (SELECT DISTINCT subject_id, object_id FROM revisions JOIN entities s ON s.entity_id = subject_id AND s.entity_type = 'Supplier' JOIN entities o ON o.entity_id = object_id AND o.entity_type = 'Part'
  WHERE kind = 'ASSERTION' AND object_kind = 'entity' AND predicate = 'SUPPLIES')
SELECT 'RELATIONSHIP_ENDPOINT_CARDINALITY_INVALID' AS code, 'ERROR' AS severity, 'Entity' AS object_kind, entity_id AS object_id, 'SUPPLIES source' AS detail FROM entities WHERE entity_type = 'Supplier' AND entity_id NOT IN (SELECT subject_id FROM pairs)""")
def audit_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.endpoint_findings(published(spark, sf_dir))


@query(f"""WITH {BASE}, f AS (SELECT subject_id, predicate, count(DISTINCT canonical_value) AS n FROM revisions WHERE kind = 'ASSERTION' AND object_kind = 'literal' GROUP BY 1, 2)
SELECT 'REQUIRED_ENTITY_PROPERTY_MISSING' AS code, 'ERROR' AS severity, 'Entity' AS object_kind, e.entity_id AS object_id, 'Size' AS detail FROM entities e LEFT JOIN f ON f.subject_id = e.entity_id AND f.predicate = 'Size'
WHERE e.entity_type = 'Part' AND coalesce(f.n, 0) = 0
UNION ALL SELECT 'ENTITY_PROPERTY_CARDINALITY_INVALID', 'ERROR', 'Entity', e.entity_id, f.predicate FROM entities e JOIN f ON f.subject_id = e.entity_id WHERE f.n > 1 AND ((e.entity_type, f.predicate) IN (('Part', 'Size'), ('Supplier', 'Rating')))""")
def audit_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.property_findings(published(spark, sf_dir))


@query(f"""WITH {BASE}, {_ENTITIES_SQL}, found AS ({REVISIONS_SQL} UNION ALL SELECT code, severity, 'Entity', entity_id FROM entity_found),
t AS (SELECT count(*) AS total, count(*) FILTER (severity = 'ERROR') AS errors FROM found)
SELECT 'published-quality-issue:' || sha256(concat_ws('|', 'run-1', code, severity, object_kind, object_id)) AS issue_id, code, severity, object_kind, object_id, total, errors, total > 200 AS truncated
FROM (SELECT * FROM found ORDER BY code, object_kind, object_id LIMIT 200), t""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first findings of the whole audit, and its totals."""
    t = published(spark, sf_dir)
    found = _run(spark, sf_dir).unionByName(stage(audit.entity_findings(t, PUBLICATION, HUB), "audit-entities"))  # read for the totals, too
    return audit.report(found, "run-1", 200)


@query(f"""WITH {BASE}, found AS ({REVISIONS_SQL}), o AS (SELECT object_kind, object_id, list_sort(list(DISTINCT code)) AS codes FROM found GROUP BY 1, 2),
s AS (SELECT * FROM o ORDER BY sha256(concat_ws('|', 'run-1', object_kind, object_id)) LIMIT 40)
SELECT s.object_kind, s.object_id, codes, [chunk_id] AS chunks FROM s JOIN revisions ON revision_id = s.object_id""")
def audit_review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's objects to look at, with their codes and evidence."""
    t = published(spark, sf_dir)
    evidence = t["revisions"].select(F.col("revision_id").alias("object_id"), "chunk_id")
    return audit.review_sample(_run(spark, sf_dir), evidence, "run-1", 40)


_HISTORY = _ENTITIES_SQL.replace("entity_found AS", "late_found AS").replace(f">= {HUB}", f">= {HUB + 30}")


@query(f"""WITH {BASE}, {_ENTITIES_SQL}, {_HISTORY[_HISTORY.index("late_found AS"):]},
a AS (SELECT code, entity_id FROM entity_found), b AS (SELECT code, entity_id FROM late_found WHERE code <> 'ISOLATED_ENTITY')
SELECT coalesce(a.code, b.code) AS code, coalesce(a.entity_id, b.entity_id) AS object_id, CASE WHEN a.code IS NULL THEN 'NEW' WHEN b.code IS NULL THEN 'RESOLVED' ELSE 'PERSISTING' END AS state
FROM a FULL JOIN b ON a.code = b.code AND a.entity_id = b.entity_id""")
def audit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the findings of one run in the next, which has a higher hub threshold and finds isolated entities no fault."""
    t = published(spark, sf_dir)
    now = audit.entity_findings(t, PUBLICATION, HUB + 30).filter("code <> 'ISOLATED_ENTITY'")
    return audit.compared(audit.entity_findings(t, PUBLICATION, HUB), now).select("code", "object_id", "state")


@query(f"""WITH {BASE}, {_ENTITIES_SQL}, d AS (SELECT code, entity_id, CASE WHEN entity_id LIKE 's%' THEN 'ACCEPTED' WHEN entity_id LIKE 'x%' THEN 'FALSE_POSITIVE' END AS decision FROM entity_found)
SELECT code, count(*) AS n, count(decision) AS decided, count(*) FILTER (decision = 'ACCEPTED') AS accepted, count(*) FILTER (decision = 'FALSE_POSITIVE') AS false_positives FROM d GROUP BY code""")
def audit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People's last decisions on the findings, by code; suppliers' were first refused, then accepted."""
    found = audit.entity_findings(published(spark, sf_dir), PUBLICATION, HUB)
    s, x = found.filter("object_id LIKE 's%'"), found.filter("object_id LIKE 'x%'")
    made = lambda rows, decision, at: rows.select("code", "object_id", F.lit(decision).alias("decision"), F.lit(at).alias("decided_at"))
    decisions = made(s, "FALSE_POSITIVE", 1).unionByName(made(s, "ACCEPTED", 2)).unionByName(made(x, "FALSE_POSITIVE", 1))
    last = audit.decided(found, decisions)
    return last.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.count("decision").alias("decided"), F.count_if(F.col("decision") == "ACCEPTED").alias("accepted"),
        F.count_if(F.col("decision") == "FALSE_POSITIVE").alias("false_positives"),
    )
