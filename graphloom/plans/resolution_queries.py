"""Entity resolution and fact assessment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import name_key
from graphloom.operators import resolution
from graphloom.plans.registry import query
from graphloom.sources.tables import load
from graphloom.staging import many

KEY = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"SELECT {KEY.format('p_name')} AS name_key, count(*) AS n_entities, min(p_partkey) AS first_id, count(DISTINCT p_type) AS n_types FROM part GROUP BY 1 HAVING count(*) > 1")
def name_key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that several entities share."""
    return load(spark, sf_dir, "part").groupBy(name_key(F.col("p_name")).alias("name_key")).agg(
        F.count(F.lit(1)).alias("n_entities"), F.min("p_partkey").alias("first_id"), F.count_distinct("p_type").alias("n_types")
    ).filter("n_entities > 1")


@query(f"SELECT {KEY.format('p_brand')} AS alias_key, p_type AS entity_type, count(DISTINCT p_partkey) AS n_entities FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) > 1")
def alias_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that several entities of one type share."""
    return load(spark, sf_dir, "part").groupBy(name_key(F.col("p_brand")).alias("alias_key"), F.col("p_type").alias("entity_type")).agg(
        F.count_distinct("p_partkey").alias("n_entities")
    ).filter("n_entities > 1")


def _parties(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("PARTY").alias("entity_type"), F.col("c_nationkey").alias("nation"),
        F.concat(F.lit("k"), F.col("c_custkey")).alias("code"), F.regexp_replace("c_name", "(?i)customer", "party").alias("name"),
    )
    s = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 == 0, "PLANT").otherwise("PARTY").alias("entity_type"),
        F.col("s_nationkey").alias("nation"), F.concat(F.lit("k"), F.col("s_suppkey") * 2).alias("code"),
        F.regexp_replace("s_name", "(?i)supplier", "party").alias("name"),
    )
    return c, s


PARTIES_SQL = """c AS (SELECT c_custkey AS id, 'PARTY' AS entity_type, c_nationkey AS nation, 'k' || c_custkey AS code, regexp_replace(c_name, '(?i)customer', 'party', 'g') AS name FROM customer),
s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'PLANT' ELSE 'PARTY' END AS entity_type, s_nationkey AS nation, 'k' || (s_suppkey * 2) AS code, regexp_replace(s_name, '(?i)supplier', 'party', 'g') AS name FROM supplier)"""


@query(f"""WITH {PARTIES_SQL} SELECT c.id AS left_id, s.id AS right_id, CASE WHEN c.entity_type <> s.entity_type THEN 'KEEP_SEPARATE'
  WHEN c.code = s.code THEN 'MERGE' WHEN c.nation <> s.nation THEN 'KEEP_SEPARATE' ELSE 'HUMAN_REVIEW' END AS decision
  FROM c JOIN s ON c.code = s.code OR {KEY.format('c.name')} = {KEY.format('s.name')}""")
def pair_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions for all pairs that share a code or a name; other pairs stay separate."""
    c, s = _parties(spark, sf_dir)
    return resolution.resolve_pairs(c, s)


@query(f"""WITH {PARTIES_SQL}, t AS (SELECT id, code, {KEY.format('name')} AS nk, entity_type FROM s),
k AS (SELECT code, count(*) AS n, min(id) AS id FROM t WHERE entity_type = 'PARTY' GROUP BY 1), m AS (SELECT nk, count(*) AS n, min(id) AS id FROM t WHERE entity_type = 'PARTY' GROUP BY 1)
SELECT c.id AS candidate_id, CASE WHEN k.n > 1 THEN 'CONFLICT' WHEN k.n = 1 THEN 'CANONICAL_KEY' WHEN m.n > 1 THEN 'CONFLICT' WHEN m.n = 1 THEN 'EXACT_NAME' ELSE 'NO_MATCH' END AS step,
  CASE WHEN k.n = 1 THEN k.id WHEN k.n IS NULL AND m.n = 1 THEN m.id END AS match_id,
  CASE WHEN k.n = 1 THEN 1.0::DOUBLE WHEN k.n IS NULL AND m.n = 1 THEN 0.98::DOUBLE END AS confidence
FROM c LEFT JOIN k ON c.code = k.code LEFT JOIN m ON {KEY.format('c.name')} = m.nk""")
def resolution_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's first step that finds an authority: canonical key, then exact name."""
    c, s = _parties(spark, sf_dir)
    return resolution.ladder(c, s.filter("entity_type = 'PARTY'"))


@query()
def resolution_ladder_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps: canonical key, governed alias, exact name, similar name of at least 0.84; parties declare no identity properties."""
    c, s = _parties(spark, sf_dir)
    named = lambda rows, table, key, name: rows.join(
        many(load(spark, sf_dir, table).select(F.col(key).alias("id"), F.array(name).alias("aliases"))), "id"
    ).withColumn("identity", F.lit(None).cast("string"))
    return resolution.full_ladder(named(c, "customer", "c_custkey", "c_name"), named(s.filter("entity_type = 'PARTY'"), "supplier", "s_suppkey", "s_name"))


@query()
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose name key resembles a nation's: the best by matching blocks (Ratcliff-Obershelp), at least 0.1."""
    names = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), name_key(F.col("s_name")).alias("name_key"))
    authority = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("authority_id"), name_key(F.col("n_name")).alias("authority_key"))
    return resolution.similar_names(names, authority, least=0.1, most=5)


FACTS_SQL = """facts AS (SELECT l_partkey AS subject, 'Tax' AS predicate, l_orderkey AS source, round(l_tax, 2)::VARCHAR AS signature FROM lineitem),
old AS (SELECT subject, predicate, signature FROM facts WHERE source % 2 = 0)"""


@query("""WITH f AS (SELECT DISTINCT l_partkey AS subject, l_returnflag AS signature FROM lineitem WHERE l_orderkey % 2 = 1),
o AS (SELECT l_partkey AS subject, list_sort(list(DISTINCT l_returnflag)) AS sigs FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1)
SELECT f.subject, f.signature, CASE WHEN f.signature IS NULL THEN 'UNAVAILABLE' WHEN o.sigs IS NULL THEN 'READY' WHEN list_contains(o.sigs, f.signature) THEN 'DUPLICATE' ELSE 'CONFLICT' END AS state
FROM f LEFT JOIN o ON f.subject = o.subject""")
def fact_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New facts against published ones: READY, DUPLICATE, CONFLICT or UNAVAILABLE."""
    l = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("signature"), "l_orderkey")
    return resolution.classify_facts(
        l.filter("l_orderkey % 2 = 1").select("subject", "signature").distinct(), l.filter("l_orderkey % 2 = 0").select("subject", "signature")
    )


@query("SELECT l_orderkey AS subject, count(DISTINCT l_linestatus) AS n_signatures, list_sort(list(DISTINCT l_linestatus)) AS signatures FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1")
def fact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-valued facts with more than one meaning."""
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("subject")).agg(
        F.count_distinct("l_linestatus").alias("n_signatures"), F.array_sort(F.collect_set("l_linestatus")).alias("signatures")
    ).filter("n_signatures > 1")


@query("SELECT l_orderkey AS entity_id, min(l_returnflag) || '/' || min(l_linestatus) AS identity FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1 AND count(DISTINCT l_linestatus) = 1")
def identity_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with exactly one value for each identity property."""
    g = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("entity_id")).agg(
        F.count_distinct("l_returnflag").alias("a"), F.count_distinct("l_linestatus").alias("b"),
        F.concat_ws("/", F.min("l_returnflag"), F.min("l_linestatus")).alias("identity"),
    )
    return g.filter("a = 1 AND b = 1").select("entity_id", "identity")


@query("""SELECT l_partkey AS entity_id FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3""")
def all_of_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that hold all of the wanted properties (relational division)."""
    wanted = ["A", "N", "R"]
    return load(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin(wanted)).groupBy(F.col("l_partkey").alias("entity_id")).agg(
        F.count_distinct("l_returnflag").alias("n")
    ).filter(F.col("n") == len(wanted)).select("entity_id")


@query("""WITH r AS (SELECT o_orderkey AS record_id, o_custkey % 7000 AS value FROM orders), t AS (SELECT c_custkey % 5000 AS key, count(*) AS n, min(c_custkey) AS id FROM customer GROUP BY 1)
SELECT record_id, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS state, CASE WHEN n = 1 THEN id END AS target_id FROM r LEFT JOIN t ON r.value = t.key""")
def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by a key that may be missing or shared."""
    r = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), (F.col("o_custkey") % 7000).alias("value"))
    t = load(spark, sf_dir, "customer").select((F.col("c_custkey") % 5000).alias("key"), F.col("c_custkey").alias("id"))
    return resolution.resolve_references(r, t)


@query("""WITH f AS (SELECT 'o_custkey' AS field, count(*) AS n, count(DISTINCT o_custkey) AS d, sum((o_custkey IN (SELECT c_custkey FROM customer))::INT)::BIGINT AS hits FROM orders
UNION ALL SELECT 'o_orderkey', count(*), count(DISTINCT o_orderkey), sum((o_orderkey IN (SELECT c_custkey FROM customer))::INT)::BIGINT FROM orders)
SELECT field, n = d AS is_identifier, hits > 0 AS is_reference FROM f""")
def reference_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fields identify their records, and which hold identifiers of other records."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).distinct().withColumn("hit", F.lit(1))
    out = None
    for field in ("o_custkey", "o_orderkey"):
        one = o.join(c, F.col(field) == F.col("k"), "left").agg(
            F.lit(field).alias("field"), (F.count(F.lit(1)) == F.count_distinct(field)).alias("is_identifier"), (F.count("hit") > 0).alias("is_reference")
        )
        out = one if out is None else out.unionByName(one)
    return out
