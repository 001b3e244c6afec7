"""Audits and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import quality_audit as audit
from graphloom.plans.registry import query
from graphloom.sources.derived import SUPPLIES_SQL, mentions, revisions, supplies
from graphloom.sources.tables import load


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), F.col("source"))


@query("SELECT doc_id AS entity_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label mentions."""
    return audit.orphans(_documents(spark, sf_dir), load(spark, sf_dir, "labels").select(F.col("doc_id").alias("entity_id"))).select("entity_id")


@query("SELECT doc_id AS entity_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)")
def isolated_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without an edge to a vector."""
    edges = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("object"))
    return audit.isolated(_documents(spark, sf_dir).select("entity_id"), edges)


@query("SELECT p_partkey AS entity_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)")
def isolated_entities_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without an edge from any supplier."""
    return audit.isolated(_parts(spark, sf_dir), supplies(spark, sf_dir))


@query(f"WITH {SUPPLIES_SQL} SELECT subject AS entity_id, count(DISTINCT object) AS degree FROM supplies GROUP BY 1 HAVING count(DISTINCT object) > 520")
def anomalous_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.hubs(supplies(spark, sf_dir), 520, inclusive=False)


@query(f"WITH {SUPPLIES_SQL} SELECT subject AS entity_id, count(DISTINCT object) AS degree FROM supplies GROUP BY 1 HAVING count(DISTINCT object) >= 520")
def anomalous_hub_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.hubs(supplies(spark, sf_dir), 520, inclusive=True)


@query("""WITH n AS (SELECT c_custkey AS entity_id, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT entity_id, n FROM n WHERE n NOT BETWEEN 5 AND 15""")
def endpoint_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with fewer than 5 or more than 15 orders."""
    edges = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("object"))
    return audit.endpoint_cardinality(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id")), edges, 5, 15)


@query("""WITH n AS (SELECT o_orderkey AS entity_id, count(DISTINCT l_returnflag) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT entity_id, CASE WHEN n = 0 THEN 'REQUIRED_ENTITY_PROPERTY_MISSING' ELSE 'ENTITY_PROPERTY_CARDINALITY_INVALID' END AS code FROM n WHERE n <> 1""")
def property_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_returnflag").alias("signature"))
    return audit.property_cardinality(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity_id")), facts, True, True)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> nation -> region as child -> parent."""
    s = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    n = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return s.unionByName(n)


@query("""WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
h AS (SELECT DISTINCT parent AS node, 0 AS depth, parent AS root FROM e WHERE parent NOT IN (SELECT child FROM e)
  UNION ALL SELECT e.child, depth + 1, root FROM h JOIN e ON e.parent = h.node) SELECT node, depth, root FROM h""")
def hierarchy_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.hierarchy(_tree(spark, sf_dir), spark)


@query("""WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION SELECT 'c' || n_nationkey, 'c' || (n_nationkey + 1) % 6 FROM nation WHERE n_nationkey < 6),
reach AS (SELECT child AS a, parent AS b FROM e UNION SELECT reach.a, e.parent FROM reach JOIN e ON e.child = reach.b),
cyclic AS (SELECT a AS node FROM reach WHERE a = b)
SELECT DISTINCT child AS node FROM e WHERE child IN (SELECT node FROM cyclic UNION SELECT b FROM reach WHERE a IN (SELECT node FROM cyclic)) AND child IN (SELECT a FROM reach WHERE b IN (SELECT node FROM cyclic))""")
def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of six nations beside the tree: only the ring is cyclic."""
    ring = load(spark, sf_dir, "nation").filter("n_nationkey < 6").select(
        F.concat(F.lit("c"), "n_nationkey").alias("child"), F.concat(F.lit("c"), (F.col("n_nationkey") + 1) % 6).alias("parent")
    )
    return audit.in_cycles(_tree(spark, sf_dir).unionByName(ring))


@query(f"""WITH {SUPPLIES_SQL}
SELECT 'ERROR' AS severity, 'ORPHAN_ENTITY' AS code, doc_id::VARCHAR AS record_id, source AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
UNION ALL SELECT 'WARNING', 'ANOMALOUS_HUB', subject::VARCHAR, count(DISTINCT object)::VARCHAR FROM supplies GROUP BY subject HAVING count(DISTINCT object) > 520
UNION ALL SELECT 'WARNING', 'POTENTIAL_DUPLICATE_NAME', min(p_partkey)::VARCHAR, lower(p_name) FROM part GROUP BY p_type, lower(p_name) HAVING count(*) > 1
UNION ALL SELECT 'ERROR', 'INVALID_RELATIONSHIP_PATTERN', l_orderkey || ':' || l_linenumber, l_returnflag || l_linestatus FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'F'""")
def quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of several rules in one report."""
    p, l = load(spark, sf_dir, "part"), load(spark, sf_dir, "lineitem")
    names = p.groupBy("p_type", F.lower("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("id")).filter("n > 1")
    bad = l.filter("l_returnflag = 'N' AND l_linestatus = 'F'")
    return audit.all_findings([
        audit.finding(_documents(spark, sf_dir).join(orphan_entities(spark, sf_dir), "entity_id", "left_semi"), "ERROR", "ORPHAN_ENTITY", F.col("entity_id"), F.col("source")),
        audit.finding(anomalous_hub(spark, sf_dir), "WARNING", "ANOMALOUS_HUB", F.col("entity_id"), F.col("degree")),
        audit.finding(names, "WARNING", "POTENTIAL_DUPLICATE_NAME", F.col("id"), F.col("name")),
        audit.finding(bad, "ERROR", "INVALID_RELATIONSHIP_PATTERN", F.concat_ws(":", "l_orderkey", "l_linenumber"), F.concat("l_returnflag", "l_linestatus")),
    ])


@query("""WITH a AS (SELECT 'ORPHAN' AS code, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL))
SELECT code, sha256(code || '|' || id) AS issue_id, id FROM a ORDER BY sha256(code || '|' || id) LIMIT 25""")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic sample of findings: the 25 smallest hashes."""
    a = orphan_entities(spark, sf_dir).select(F.lit("ORPHAN").alias("code"), F.col("entity_id").alias("id"))
    return a.select("code", F.sha2(F.concat_ws("|", "code", "id"), 256).alias("issue_id"), "id").orderBy("issue_id").limit(25)


@query("""SELECT o_custkey AS scope, o_orderpriority AS business_key, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def scoped_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business keys that occur more than once in their scope."""
    return load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("scope"), F.col("o_orderpriority").alias("business_key")).agg(
        F.count(F.lit(1)).alias("n")
    ).filter("n > 1")


#: The legal next statuses.
TRANSITIONS = (("PENDING", "APPROVED"), ("PENDING", "REJECTED"), ("APPROVED", "PUBLISHED"), ("REJECTED", "PENDING"), ("QUARANTINED", "PENDING"))


@query("""WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'PENDING' WHEN 'view' THEN 'APPROVED' WHEN 'purchase' THEN 'PUBLISHED' WHEN 'signup' THEN 'REJECTED' WHEN 'error' THEN 'QUARANTINED' END AS status,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
t AS (SELECT user_id, event_id, status, CASE before WHEN 'click' THEN 'PENDING' WHEN 'view' THEN 'APPROVED' WHEN 'purchase' THEN 'PUBLISHED' WHEN 'signup' THEN 'REJECTED' WHEN 'error' THEN 'QUARANTINED' END AS previous FROM s)
SELECT user_id, event_id, previous, status FROM t WHERE previous IS NOT NULL AND (previous || '>' || status) NOT IN ('PENDING>APPROVED', 'PENDING>REJECTED', 'APPROVED>PUBLISHED', 'REJECTED>PENDING', 'QUARANTINED>PENDING')""")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of a user's events that are not in the table of legal ones."""
    from pyspark.sql import Window

    from graphloom.sources.derived import EVENT_STATUS

    status = F.create_map(*[F.lit(x) for pair in EVENT_STATUS.items() for x in pair])[F.col("event_type")]
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", status.alias("status"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = e.withColumn("previous", F.lag("status").over(order)).filter("previous IS NOT NULL")
    legal = spark.createDataFrame(TRANSITIONS, "previous string, status string")
    return steps.join(F.broadcast(legal), ["previous", "status"], "left_anti").select("user_id", "event_id", "previous", "status")


@query("SELECT p_partkey AS entity_id, CASE WHEN p_size < 1 OR p_size > 45 THEN 'SIZE_RANGE' WHEN p_brand NOT LIKE 'Brand#%' THEN 'BRAND_PATTERN' END AS code FROM part WHERE p_size < 1 OR p_size > 45 OR p_brand NOT LIKE 'Brand#%'")
def property_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range and pattern rules on properties."""
    code = F.when(~F.col("p_size").between(1, 45), "SIZE_RANGE").when(~F.col("p_brand").like("Brand#%"), "BRAND_PATTERN")
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), code.alias("code")).filter("code IS NOT NULL")


@query("SELECT o_orderkey AS entity_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def conditional_requirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders must have a finished line."""
    done = load(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("entity_id"))
    return load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("entity_id")).join(done, "entity_id", "left_anti")
