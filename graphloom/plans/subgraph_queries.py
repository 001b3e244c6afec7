"""Evidence subgraphs of many requests for one reader, over governed tables derived from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import access, subgraph
from graphloom.plans.registry import query
from graphloom.sources.tables import load
from graphloom.staging import stage

READER = access.Principal("t0", ("g0", "g1", "src1", "src4"))
UNTIL, TRUST, ONTOLOGY = "2024-01-01 20:00:00", "AUTHORITATIVE_AND_SECONDARY", "o2"
LIMITS = subgraph.Limits(chunks=20, entities=14, assertions=12, paths=5, mentions_per_entity=2, evidence_chars=9000)
TYPES = ("Thing", "Place")
RELATIONS = (("NEAR", "Thing", "Thing"), ("NEAR", "Thing", "Place"), ("NEAR", "Place", "Thing"), ("WITHIN", "Thing", "Place"), ("WITHIN", "Place", "Place"))
PROPERTIES = (("Thing", "Code"),)

_GROUPS = "split(concat(source, ',g', n % 3), ',')"
_SPAN = "char_start, char_end, quoted"
_BINDING = "chunk_id, document_id, version_id, policy_id, policy_version, access_groups"
#: (name, SQL): each table is made from those before it; in each, some rows break one rule each.
TABLES = (
    ("document", f"""SELECT concat('d', n) AS document_id, CASE WHEN n % 29 = 7 THEN 't1' ELSE 't0' END AS tenant_id, CASE WHEN n % 43 = 9 THEN split('closed', ',') ELSE {_GROUPS} END AS access_groups,
  concat('p', n % 4) AS policy_id, 2 AS policy_version, CASE WHEN n % 37 = 11 THEN 'RETIRED' WHEN n % 5 <> 0 THEN 'ACTIVE' END AS lifecycle, CASE WHEN n % 41 = 9 THEN 'r1' END AS retirement_id FROM {{whole}}"""),
    ("version", """SELECT concat('v', n) AS version_id, concat('d', n) AS document_id, CASE WHEN n % 47 = 3 THEN 't1' ELSE 't0' END AS tenant_id, CASE WHEN n % 17 = 0 THEN 'RETIRED' END AS lifecycle,
  CASE WHEN n % 53 = 5 THEN 'r2' END AS retirement_id, CAST(concat('2024-01-01 ', lpad(CAST(CAST(floor(n % 1440 / 60) AS INT) AS STRING), 2, '0'), ':', lpad(CAST(n % 60 AS STRING), 2, '0'), ':00') AS TIMESTAMP) AS published_at FROM {whole}"""),
    ("snapshot", """SELECT concat('n', n) AS snapshot_id, concat('d', n) AS document_id, CASE WHEN n % 67 = 6 THEN 'v0' ELSE concat('v', n) END AS version_id, CASE WHEN n % 59 = 2 THEN 't1' ELSE 't0' END AS tenant_id,
  CASE WHEN n % 23 = 4 THEN 'BUILDING' WHEN n % 2 = 0 THEN 'RETIRED' ELSE 'PUBLISHED' END AS build_state, CASE WHEN n % 31 = 8 THEN 'r3' END AS retirement_id FROM {whole}"""),
    ("chunk", f"""SELECT concat('c', n, '-', ordinal) AS chunk_id, concat('n', n) AS snapshot_id, concat('d', n) AS document_id, concat('v', n) AS version_id, CASE WHEN (n + ordinal) % 61 = 3 THEN 't1' ELSE 't0' END AS tenant_id,
  CASE WHEN (n + ordinal) % 13 = 5 THEN split('closed', ',') ELSE {_GROUPS} END AS access_groups, CASE WHEN (n + ordinal) % 71 = 1 THEN 'p9' ELSE concat('p', n % 4) END AS policy_id,
  CASE WHEN (n + ordinal) % 19 = 3 THEN 1 ELSE 2 END AS policy_version, char_start, char_end, text, n, ordinal FROM {{piece}}"""),
    ("mark", """SELECT concat('m', n, '-', ordinal, '-', k) AS revision_id, n + ordinal + k AS f, k, concat('e:', lower(substr(text, 40 * k + 6, 3))) AS entity_id, chunk_id, document_id, version_id, policy_id, policy_version,
  access_groups, char_start + 40 * k + 5 AS char_start, char_start + 40 * k + 9 AS char_end, substr(text, 40 * k + 6, 4) AS quoted, n, ordinal
  FROM {chunk} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks WHERE length(text) >= 40 * k + 9"""),
    ("mention", """SELECT revision_id, CASE WHEN f % 71 = 2 THEN 't1' ELSE 't0' END AS tenant_id, CASE WHEN f % 73 = 2 THEN 'APPROVED' ELSE 'PUBLISHED' END AS status,
  CASE WHEN f % 7 = 1 THEN 'SECONDARY' WHEN f % 11 = 2 THEN 'CANDIDATE' ELSE 'AUTHORITATIVE' END AS authority, CASE WHEN f % 79 = 4 THEN 'o1' ELSE 'o2' END AS ontology, entity_id,
  CASE WHEN substr(entity_id, 3) LIKE '%a%' OR entity_id LIKE '%o%' THEN 'Thing' WHEN substr(entity_id, 3) LIKE '%e%' OR entity_id LIKE '%n%' THEN 'Place' ELSE 'Other' END AS entity_type, chunk_id, CASE WHEN f % 107 = 1 THEN 'd0' ELSE document_id END AS document_id,
  CASE WHEN f % 101 = 8 THEN 'v0' ELSE version_id END AS version_id, CASE WHEN f % 103 = 7 THEN 'p8' ELSE policy_id END AS policy_id, CASE WHEN f % 83 = 5 THEN 9 ELSE policy_version END AS policy_version,
  CASE WHEN f % 89 = 6 THEN split('g0', ',') ELSE access_groups END AS access_groups, char_start, char_end, CASE WHEN f % 97 = 7 THEN 'zzzz' ELSE quoted END AS quoted FROM {mark}"""),
    ("entity", "SELECT DISTINCT entity_id, entity_type FROM {mention}"),
    ("pair", """SELECT concat('a', n, '-', ordinal, '-', k) AS revision_id, n + ordinal + k AS f, k, concat('e:', lower(substr(text, 40 * k + 6, 3))) AS subject_id, concat('m', n, '-', ordinal, '-', k) AS subject_mention,
  concat('e:', lower(substr(text, 40 * k + 46, 3))) AS object_id, concat('m', n, '-', ordinal, '-', k + 1) AS object_mention, chunk_id, document_id, version_id, policy_id, policy_version, access_groups,
  char_start + 40 * k + 5 AS char_start, char_start + 40 * k + 49 AS char_end, substr(text, 40 * k + 6, 44) AS quoted FROM {chunk} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) ks WHERE length(text) >= 40 * k + 49"""),
    ("assertion", f"""SELECT revision_id, CASE WHEN f % 71 = 3 THEN 't1' ELSE 't0' END AS tenant_id, CASE WHEN f % 73 = 3 THEN 'APPROVED' ELSE 'PUBLISHED' END AS status,
  CASE WHEN f % 11 = 3 THEN 'CANDIDATE' ELSE 'AUTHORITATIVE' END AS authority, CASE WHEN f % 79 = 5 THEN 'o1' ELSE 'o2' END AS ontology, CASE WHEN f % 109 = 4 THEN 'FAR' WHEN k = 0 THEN 'NEAR' ELSE 'WITHIN' END AS predicate,
  subject_id, CASE WHEN f % 107 = 3 THEN 'm0-0-0' ELSE subject_mention END AS subject_mention, 'entity' AS object_kind, object_id,
  CASE WHEN f % 113 <> 5 THEN object_mention END AS object_mention, CAST(NULL AS STRING) AS literal, {_BINDING}, char_start,
  CASE WHEN f % 103 = 9 THEN char_end - 2 ELSE char_end END AS char_end, CASE WHEN f % 103 = 9 THEN substr(quoted, 1, 42) ELSE quoted END AS quoted FROM {{pair}}
  UNION ALL SELECT concat('l', n, '-', ordinal), 't0', 'PUBLISHED', 'AUTHORITATIVE', 'o2', 'Code', entity_id, revision_id, 'literal', CASE WHEN f % 31 = 2 THEN entity_id END, NULL,
  CASE WHEN f % 19 = 6 THEN '' WHEN f % 23 = 6 THEN 'absent' ELSE substr(quoted, 2, 2) END, {_BINDING}, {_SPAN} FROM {{mark}} WHERE k = 0"""),
    ("request", "SELECT n AS request_id, concat('c', n + CAST(floor(j / 2) AS INT), '-', j % 2) AS chunk_id FROM {whole} CROSS JOIN {beside} WHERE n % 100 = 0 AND (j < 20 OR n % 1000 = 500)"),
)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), "source", "text")
    size = F.length("text")
    cut = docs.filter(size > 0).withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / 1200).cast("int"))))
    t = {
        "whole": docs.select("n", "source"), "beside": spark.range(25).select(F.col("id").cast("int").alias("j")),
        "piece": cut.select(
            "n", "source", "ordinal", (F.col("ordinal") * 1200).alias("char_start"), F.least((F.col("ordinal") + 1) * 1200, size).alias("char_end"),
            F.substr("text", F.col("ordinal") * 1200 + 1, F.lit(1200)).alias("text")),
    }
    for name, sql in TABLES:
        t[name] = spark.sql(sql, **{k: v for k, v in t.items() if "{" + k + "}" in sql})
    return t


def governed(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readable chunks, and the mentions and assertions that hold in them."""
    spark = t["whole"].sparkSession
    chunks = stage(access.readable_chunks(t["document"], t["version"], t["snapshot"], t["chunk"], READER, published_until=UNTIL), "readable-chunks")
    types, relations = spark.createDataFrame([(x,) for x in TYPES], "name string"), spark.createDataFrame(RELATIONS, "name string, source_type string, target_type string")
    properties = spark.createDataFrame(PROPERTIES, "entity_type string, name string")
    mentions = stage(subgraph.governed_mentions(t["mention"], t["entity"], types, chunks, READER, TRUST, ONTOLOGY), "governed-mentions")
    return chunks, mentions, subgraph.governed_assertions(t["assertion"], mentions, relations, properties, chunks, READER, TRUST, ONTOLOGY)


def _duck(sql: str) -> str:
    for name in ("whole", "piece", "beside", *(n for n, _ in TABLES)):
        sql = sql.replace("{" + name + "}", f"g_{name}")
    return sql


_LISTED = "[" + ", ".join(f"'{g}'" for g in READER.groups) + "]"
_MAY = f"tenant_id = 't0' AND len(list_intersect(access_groups, {_LISTED})) > 0"
BASE = """g_whole AS (SELECT doc_id AS n, source FROM documents), g_beside AS (SELECT j FROM range(0, 25) t(j)),
g_piece AS (SELECT doc_id AS n, o AS ordinal, o * 1200 AS char_start, least((o + 1) * 1200, length(text)) AS char_end, substr(text, o * 1200 + 1, 1200) AS text, source
  FROM (SELECT *, unnest(range(0, ((length(text) + 1199) // 1200)::BIGINT)) AS o FROM documents)),
""" + ",\n".join(f"g_{name} AS ({_duck(sql)})" for name, sql in TABLES)
CHUNKS_SQL = f"""readable AS (SELECT c.* FROM g_chunk c WHERE {_MAY} AND EXISTS (FROM g_document d JOIN g_version v ON v.document_id = d.document_id JOIN g_snapshot s ON s.version_id = v.version_id AND s.document_id = d.document_id
  WHERE d.document_id = c.document_id AND v.version_id = c.version_id AND s.snapshot_id = c.snapshot_id AND d.policy_id = c.policy_id AND d.policy_version = c.policy_version
    AND d.tenant_id = 't0' AND v.tenant_id = 't0' AND s.tenant_id = 't0' AND len(list_intersect(d.access_groups, {_LISTED})) > 0 AND coalesce(d.lifecycle, 'ACTIVE') = 'ACTIVE' AND coalesce(v.lifecycle, 'ACTIVE') = 'ACTIVE'
    AND d.retirement_id IS NULL AND v.retirement_id IS NULL AND s.retirement_id IS NULL AND s.build_state <> 'BUILDING' AND v.published_at <= TIMESTAMP '{UNTIL}'))"""
_HOLDS = f"""SELECT x.*, length(c.text) AS size FROM {{}} x JOIN readable c USING (chunk_id) WHERE x.status = 'PUBLISHED' AND x.ontology = 'o2' AND x.authority <> 'CANDIDATE' AND x.tenant_id = 't0'
  AND len(list_intersect(x.access_groups, {_LISTED})) > 0 AND x.document_id = c.document_id AND x.version_id = c.version_id AND x.policy_id = c.policy_id AND x.policy_version = c.policy_version AND x.access_groups = c.access_groups
  AND x.char_start >= c.char_start AND x.char_end <= c.char_end AND substr(c.text, x.char_start - c.char_start + 1, x.char_end - x.char_start) = x.quoted"""
_DECLARED = " OR ".join(f"(x.predicate = '{p}' AND s.entity_type = '{a}' AND o.entity_type = '{b}')" for p, a, b in RELATIONS)
GOVERNED_SQL = f"""{CHUNKS_SQL}, gm AS ({_HOLDS.format("g_mention")} AND x.entity_type <> 'Other'),
ga AS (SELECT x.*, s.char_start AS s_start, s.char_end AS s_end, o.char_start AS o_start, o.char_end AS o_end FROM ({_HOLDS.format("g_assertion")}) x
  JOIN gm s ON s.revision_id = x.subject_mention AND s.entity_id = x.subject_id AND s.chunk_id = x.chunk_id AND s.char_start >= x.char_start AND s.char_end <= x.char_end
  LEFT JOIN gm o ON o.revision_id = x.object_mention AND o.entity_id = x.object_id AND o.chunk_id = x.chunk_id AND o.char_start >= x.char_start AND o.char_end <= x.char_end
  WHERE (x.object_kind = 'entity' AND ({_DECLARED})) OR (x.object_kind = 'literal' AND x.object_id IS NULL AND x.literal <> '' AND contains(x.quoted, x.literal) AND x.predicate = 'Code' AND s.entity_type = 'Thing'))"""
_OF = "list_filter(w.att, lambda x: x.entity = {0}.entity{1})"
FOLD_SQL = f"""sizes AS (SELECT request_id, count(DISTINCT chunk_id) AS k FROM g_request GROUP BY 1), asked AS (SELECT DISTINCT r.* FROM g_request r JOIN sizes USING (request_id) WHERE k <= 20),
met AS (SELECT request_id, gm.*, row_number() OVER (PARTITION BY request_id ORDER BY entity_id, revision_id) AS nth FROM asked JOIN gm USING (chunk_id)),
seeds AS (SELECT request_id, entity_id AS seed, min(chunk_id) AS seed_chunk FROM met GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY seed) <= 14),
pairs AS (SELECT request_id, seed, seed_chunk, ga.* FROM seeds JOIN ga ON seed = subject_id OR seed = object_id QUALIFY row_number() OVER (PARTITION BY request_id, revision_id ORDER BY seed, seed_chunk) = 1),
cut AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY revision_id) AS nth FROM pairs QUALIFY nth <= 12),
line AS (SELECT request_id, 'mention' AS kind, nth, revision_id, entity_id, chunk_id, size, NULL::VARCHAR AS seed_chunk, [{{entity: entity_id, revision: revision_id, chunk: chunk_id}}] AS ends, [{{revision: revision_id, chunk: chunk_id, a: char_start, b: char_end}}] AS items FROM met WHERE nth <= 28
  UNION ALL SELECT request_id, 'assertion', nth, revision_id, seed, chunk_id, size, seed_chunk, [{{entity: subject_id, revision: subject_mention, chunk: chunk_id}}] || CASE WHEN object_kind = 'entity' THEN [{{entity: object_id, revision: object_mention, chunk: chunk_id}}] ELSE [] END,
    [{{revision: revision_id, chunk: chunk_id, a: char_start, b: char_end}}, {{revision: subject_mention, chunk: chunk_id, a: s_start, b: s_end}}] || CASE WHEN object_kind = 'entity' THEN [{{revision: object_mention, chunk: chunk_id, a: o_start, b: o_end}}] ELSE [] END FROM cut),
queue AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY kind DESC, nth) AS pos FROM line),
walk AS (SELECT DISTINCT request_id, 0::BIGINT AS pos, NULL::VARCHAR AS decision, []::STRUCT(entity VARCHAR, revision VARCHAR, chunk VARCHAR)[] AS att, []::STRUCT(revision VARCHAR, chunk VARCHAR, a BIGINT, b BIGINT)[] AS res,
    []::VARCHAR[] AS seen, 0::BIGINT AS used, 0::BIGINT AS taken FROM queue
  UNION ALL SELECT z.request_id, z.pos, z.decision, CASE WHEN z.decision = 'admitted' THEN z.att2 ELSE z.att END, CASE WHEN z.decision = 'admitted' THEN z.res || z.fresh ELSE z.res END,
    CASE WHEN z.decision = 'admitted' THEN list_append(z.seen, z.chunk_id) ELSE z.seen END, z.used + CASE WHEN z.decision = 'admitted' THEN z.cost ELSE 0 END, z.taken + CASE WHEN z.decision = 'admitted' AND z.kind = 'assertion' THEN 1 ELSE 0 END
  FROM (SELECT y.*, CASE WHEN y.len2 = 1 OR (len(list_filter(y.att1, lambda x: x.entity = y.ends[2].entity)) >= 2) OR len(list_filter(y.att1, lambda x: x.entity = y.ends[2].entity AND x.revision = y.ends[2].revision)) > 0 THEN y.att1 ELSE list_append(y.att1, y.ends[2]) END AS att2,
      CASE WHEN y.kind = 'assertion' AND y.taken >= 12 THEN 'assertion_limit' WHEN y.kind = 'assertion' AND NOT y.seeded THEN 'seed_not_admitted' WHEN y.n_entities > 14 THEN 'entity_limit' WHEN y.full_ THEN 'mention_limit'
        WHEN y.used + y.cost > 9000 THEN 'character_budget' ELSE 'admitted' END AS decision
    FROM (SELECT w.request_id, q.pos, q.kind, q.chunk_id, q.ends, len(q.ends) AS len2, w.att, w.res, w.seen, w.used, w.taken,
        len(list_filter(w.att, lambda x: x.entity = q.entity_id AND x.chunk = q.seed_chunk)) > 0 AS seeded, len(list_distinct(list_transform(w.att, lambda x: x.entity) || list_transform(q.ends, lambda x: x.entity))) AS n_entities,
        len(list_filter(q.ends, lambda e: len({_OF.format("e", "")}) >= 2 AND len({_OF.format("e", " AND x.revision = e.revision")}) = 0)) > 0 AS full_,
        list_filter(list_distinct(q.items), lambda i: NOT list_contains(w.res, i)) AS fresh,
        coalesce(list_sum(list_transform(list_filter(list_distinct(q.items), lambda i: NOT list_contains(w.res, i)), lambda i: i.b - i.a)), 0)
          + CASE WHEN len(list_filter(list_distinct(q.items), lambda i: NOT list_contains(w.res, i))) > 0 AND NOT list_contains(w.seen, q.chunk_id) THEN q.size ELSE 0 END AS cost,
        CASE WHEN len({_OF.format("q.ends[1]", "")}) >= 2 OR len({_OF.format("q.ends[1]", " AND x.revision = q.ends[1].revision")}) > 0 THEN w.att ELSE list_append(w.att, q.ends[1]) END AS att1
      FROM walk w JOIN queue q ON q.request_id = w.request_id AND q.pos = w.pos + 1) y) z)
SELECT request_id, kind, revision_id, entity_id, chunk_id, decision, kind = 'assertion' AND decision = 'admitted' AND count(*) FILTER (kind = 'assertion' AND decision = 'admitted') OVER (PARTITION BY request_id ORDER BY pos) <= 5 AS path
FROM walk JOIN queue USING (request_id, pos)
UNION ALL SELECT request_id, 'request', NULL, NULL, NULL, 'chunk_limit', false FROM sizes WHERE k > 20"""


@query(f"WITH {BASE}, {CHUNKS_SQL} SELECT chunk_id, document_id, char_start, char_end FROM readable")
def readable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one reader may read: tenant, groups of document and chunk, policy and version, lifecycle, retirement and publication time."""
    t = tables(spark, sf_dir)
    return access.readable_chunks(t["document"], t["version"], t["snapshot"], t["chunk"], READER, published_until=UNTIL).select("chunk_id", "document_id", "char_start", "char_end")


@query(f"WITH {BASE}, {GOVERNED_SQL} SELECT revision_id, predicate, subject_id, object_id, literal, chunk_id FROM ga")
def governed_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assertions that hold for this reader, with both ends in their chunk and declared types."""
    return governed(tables(spark, sf_dir))[2].select("revision_id", "predicate", "subject_id", "object_id", "literal", "chunk_id")


@query(f"WITH RECURSIVE {BASE}, {GOVERNED_SQL}, {FOLD_SQL}")
def evidence_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subgraph of every hundredth document's request: what is admitted, and which budget keeps out what is not."""
    t = tables(spark, sf_dir)
    _, mentions, assertions = governed(t)
    return subgraph.evidence_subgraphs(t["request"], mentions, assertions, LIMITS)
