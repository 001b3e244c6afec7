"""Revisions, review, publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import checksum
from graphloom.operators import lifecycle
from graphloom.plans.registry import query
from graphloom.sources.derived import REVISIONS_SQL, revisions
from graphloom.sources.tables import load

CUR = f"{REVISIONS_SQL}, cur AS (SELECT * FROM revisions QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY revision DESC) = 1)"
OLD, NEW = "2024-01-10", "2024-01-20"
MANIFESTS = f"""{REVISIONS_SQL},
old AS (SELECT record_id, max(revision) AS revision FROM revisions WHERE ts < TIMESTAMP '{OLD}' GROUP BY 1),
new AS (SELECT record_id, max(revision) AS revision FROM revisions WHERE ts < TIMESTAMP '{NEW}' AND ts >= TIMESTAMP '2024-01-03' GROUP BY 1)"""


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = revisions(spark, sf_dir)
    at = lambda rows: rows.groupBy("record_id").agg(F.max("revision").alias("revision"))
    return at(r.filter(f"ts < timestamp'{OLD}'")), at(r.filter(f"ts < timestamp'{NEW}' AND ts >= timestamp'2024-01-03'"))


@query(f"WITH {CUR} SELECT record_id, revision, event_id, status FROM cur")
def current_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.current(revisions(spark, sf_dir)).select("record_id", "revision", "event_id", "status")


@query(f"WITH {REVISIONS_SQL} SELECT record_id, revision, event_id, status, lag(event_id) OVER (PARTITION BY record_id ORDER BY revision) AS previous FROM revisions")
def revision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("record_id").orderBy("revision")
    return revisions(spark, sf_dir).select("record_id", "revision", "event_id", "status", F.lag("event_id").over(order).alias("previous"))


@query(f"WITH {CUR} SELECT record_id, revision, status FROM cur WHERE status IN ('PENDING', 'QUARANTINED')")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.current(revisions(spark, sf_dir)).filter(F.col("status").isin("PENDING", "QUARANTINED")).select("record_id", "revision", "status")


@query(f"""WITH {MANIFESTS}, app AS (SELECT record_id, max(revision) AS revision FROM revisions WHERE status = 'APPROVED' GROUP BY 1)
SELECT a.record_id, a.revision, o.record_id IS NOT NULL AS requires_replacement FROM app a LEFT JOIN old o ON o.record_id = a.record_id
WHERE o.revision IS NULL OR o.revision <> a.revision""")
def publication_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved revisions that the active publication lacks, and whether they replace a member of it."""
    old, _ = _manifests(spark, sf_dir)
    approved = revisions(spark, sf_dir).filter("status = 'APPROVED'").groupBy("record_id").agg(F.max("revision").alias("revision"))
    active = old.select(F.col("record_id").alias("o_id"), F.col("revision").alias("o_revision"))
    return approved.join(active, F.col("record_id") == F.col("o_id"), "left").filter("o_revision IS NULL OR o_revision <> revision").select(
        "record_id", "revision", F.col("o_id").isNotNull().alias("requires_replacement")
    )


@query(f"""WITH {MANIFESTS} SELECT coalesce(old.record_id, new.record_id) AS record_id, old.revision AS old_revision, new.revision AS new_revision,
CASE WHEN old.record_id IS NULL THEN 'ADDED' WHEN new.record_id IS NULL THEN 'REMOVED' WHEN old.revision = new.revision THEN 'UNCHANGED' ELSE 'CHANGED' END AS change
FROM old FULL JOIN new ON old.record_id = new.record_id""")
def publication_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.diff(*_manifests(spark, sf_dir))


@query(f"""WITH {MANIFESTS}, rem AS (SELECT record_id FROM old WHERE record_id LIKE '%:error'), rep AS (SELECT record_id FROM old WHERE record_id LIKE '%:view')
SELECT record_id, revision FROM old WHERE record_id NOT IN (SELECT record_id FROM rem) AND record_id NOT IN (SELECT record_id FROM rep)
UNION ALL SELECT record_id, revision FROM new WHERE record_id LIKE '%:view'""")
def publish_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next manifest: errors removed, views replaced by their new revisions."""
    old, new = _manifests(spark, sf_dir)
    view = F.col("record_id").like("%:view")
    return lifecycle.publish(old, old.filter(F.col("record_id").like("%:error")), old.filter(view), new.filter(view))


@query(f"""WITH {MANIFESTS} SELECT DISTINCT record_id, 'COLLIDES_WITH_CARRIED' AS code FROM new WHERE record_id LIKE '%:click' AND record_id IN (SELECT record_id FROM old)
UNION SELECT record_id, 'COLLIDES_WITH_REMOVED' FROM new WHERE record_id LIKE '%:error' AND record_id IN (SELECT record_id FROM old WHERE record_id LIKE '%:error')""")
def publish_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a publication that adds clicks and errors, while errors are removed, must refuse."""
    old, new = _manifests(spark, sf_dir)
    error = F.col("record_id").like("%:error")
    added = new.filter(F.col("record_id").like("%:click") | error)
    return lifecycle.collisions(old, old.filter(error), old.limit(0), added)


@query(f"""WITH {MANIFESTS} SELECT count(*) AS members, count(DISTINCT o.record_id) AS distinct_members, count(*) = count(DISTINCT o.record_id) AND count(*) = count(r.record_id) AS holds
FROM old o LEFT JOIN revisions r ON r.record_id = o.record_id AND r.revision = o.revision""")
def manifest_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every member of a manifest exists exactly once."""
    old, _ = _manifests(spark, sf_dir)
    known = revisions(spark, sf_dir).select(F.col("record_id").alias("k_id"), F.col("revision").alias("k_revision"))
    both = old.join(known, (F.col("record_id") == F.col("k_id")) & (F.col("revision") == F.col("k_revision")), "left")
    n, d = F.count(F.lit(1)), F.count_distinct("record_id")
    return both.agg(n.alias("members"), d.alias("distinct_members"), ((n == d) & (n == F.count("k_id"))).alias("holds"))


@query("SELECT source, count(*) AS members, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def snapshot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest digest of each source's snapshot."""
    d = load(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("name"))
    return lifecycle.manifest_digest(d, "source", "doc_id", "name")


@query("SELECT DISTINCT sha256(text) AS checksum, lang FROM documents WHERE doc_id % 3 < 2 AND (sha256(text), lang) NOT IN (SELECT sha256(text), lang FROM documents WHERE doc_id % 3 = 2)")
def incremental_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of one batch (two of three documents) whose artifacts the earlier batch, the third, did not make."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", checksum(F.col("text")).alias("checksum"))
    return lifecycle.to_compute(d.filter("doc_id % 3 < 2"), d.filter("doc_id % 3 = 2"), ["checksum", "lang"])


@query("SELECT DISTINCT sha256(text) AS checksum, lang FROM documents WHERE doc_id % 3 = 0 AND (sha256(text), lang) NOT IN (SELECT sha256(text), lang FROM documents WHERE doc_id % 3 <> 0)")
def incremental_inputs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of one batch whose artifacts the earlier batch, all other documents, did not make."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", checksum(F.col("text")).alias("checksum"))
    return lifecycle.to_compute(d.filter("doc_id % 3 = 0"), d.filter("doc_id % 3 <> 0"), ["checksum", "lang"])


@query("SELECT count(*) AS chunks, count(e.vec_id) AS embedded, round(count(e.vec_id) / count(*), 6) AS coverage FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "embeddings").select("vec_id")
    n, have = F.count(F.lit(1)), F.count("vec_id")
    return d.join(e, d.doc_id == e.vec_id, "left").agg(n.alias("chunks"), have.alias("embedded"), F.round(have / n, 6).alias("coverage"))


@query(f"""WITH {CUR}, m AS (SELECT record_id, split_part(record_id, ':', 1) AS u FROM cur WHERE record_id LIKE '%:click')
SELECT m.record_id AS mention, c.record_id AS assertion FROM m JOIN cur c ON split_part(c.record_id, ':', 1) = m.u AND c.record_id LIKE '%:view'
UNION SELECT m.record_id, c.record_id FROM m JOIN cur c ON split_part(c.record_id, ':', 1) = m.u AND c.record_id LIKE '%:purchase'""")
def dependent_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions that depend on a mention as subject or as object: two equi joins united."""
    cur = lifecycle.current(revisions(spark, sf_dir)).select("record_id", F.split("record_id", ":")[0].alias("u"))
    m = cur.filter(F.col("record_id").like("%:click")).select(F.col("record_id").alias("mention"), "u")
    side = lambda kind: m.join(cur.filter(F.col("record_id").like(f"%:{kind}")), "u").select("mention", F.col("record_id").alias("assertion"))
    return side("view").union(side("purchase")).distinct()
