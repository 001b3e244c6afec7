"""Loads, retirements, publications and rollbacks as commits, and what is active after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import checksum
from graphloom.operators import hierarchies
from graphloom.operators.ledger import Generations, Ledger, Refused, inventory
from graphloom.plans.registry import query
from graphloom.sources.tables import load
from graphloom.staging import staging_path

#: Each line of an order is a record; every third has a second revision, by the next supplier.
RECORDS_SQL = """line AS (SELECT l_orderkey AS k, l_linenumber AS nr, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
record AS (SELECT k || ':' || nr AS record_id, 1 AS revision, 's' || s AS subject, 'SUPPLIES' AS predicate, 'p' || p AS object, k AS chunk_id, k, nr FROM line
  UNION ALL SELECT k || ':' || nr, 2, 's' || (s + 1), 'SUPPLIES', 'p' || p, k, k, nr FROM line WHERE nr % 3 = 0),
first_members AS (SELECT * FROM record WHERE revision = 1 AND k % 5 <> 0),
second_members AS (SELECT * FROM record WHERE revision = CASE WHEN nr % 3 = 0 THEN 2 ELSE 1 END AND k % 7 <> 0)"""
_GRAPH = "SELECT subject, predicate, object, count(*) AS n, min(chunk_id) AS evidence FROM {} GROUP BY 1, 2, 3"


#: Lines that one task groups: the tasks grow with the lines, not the lines of a task.
LINES_PER_TASK = 500_000


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("nr"), "l_suppkey", "l_partkey")
    dealt = l.repartition(max(16, -(-l.count() // LINES_PER_TASK)), "k", "nr")
    lines = dealt.groupBy("k", "nr").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    both = lines.withColumn("revision", F.explode(F.when(F.col("nr") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return both.select(
        F.concat_ws(":", "k", "nr").alias("record_id"), "revision", F.concat(F.lit("s"), F.col("s") + F.col("revision") - 1).alias("subject"),
        F.lit("SUPPLIES").alias("predicate"), F.concat(F.lit("p"), "p").alias("object"), F.col("k").alias("chunk_id"), "k", "nr")


def undeclared(records: DataFrame) -> DataFrame:
    """Records whose predicate is not declared, or that lack an end."""
    return records.filter("predicate <> 'SUPPLIES' OR subject IS NULL OR object IS NULL").select("record_id")


def published(spark: SparkSession, sf_dir: str) -> tuple[Ledger, DataFrame]:
    """A ledger with the records loaded and two publications of them, the second active."""
    ledger = Ledger(spark, staging_path(spark, "ledger"))
    all_records = _records(spark, sf_dir).withColumn("id", F.concat_ws("@", "record_id", "revision"))
    ledger.load("records", all_records, "id", "load records")
    records = ledger.table("records")
    wanted = F.when(F.col("nr") % 3 == 0, 2).otherwise(1)
    ledger.publish("first", records.filter("revision = 1 AND k % 5 <> 0"), records, undeclared, None)
    ledger.publish("second", records.filter((F.col("revision") == wanted) & (F.col("k") % 7 != 0)), records, undeclared, "first")
    return ledger, records


@query(f"WITH {RECORDS_SQL} {_GRAPH.format('second_members')}")
def navigation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of the second publication, advanced from the first one's by the difference of their manifests; the SQL makes it anew."""
    return published(spark, sf_dir)[0].graph()


@query(f"WITH {RECORDS_SQL} {_GRAPH.format('first_members')}")
def navigation_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph that is active after going back to the first publication."""
    ledger, records = published(spark, sf_dir)
    ledger.rollback("first", records, undeclared, "second")
    return ledger.graph()


@query(f"""WITH {RECORDS_SQL}, g AS ({_GRAPH.format('second_members')}),
o AS (SELECT subject AS e, count(*) AS n_out, min(evidence) AS ev FROM g GROUP BY 1), i AS (SELECT object AS e, count(*) AS n_in, min(evidence) AS ev FROM g GROUP BY 1),
l AS (SELECT 'p' || p_partkey AS e, count(DISTINCT v) AS n_literals FROM (SELECT p_partkey, unnest(['Size=' || p_size, 'Brand=' || p_brand]) AS v FROM part WHERE p_partkey % 3 = 0) GROUP BY 1),
e AS (SELECT 's' || s_suppkey AS entity_id, 'Supplier' AS entity_type, s_name AS name FROM supplier UNION ALL SELECT 'p' || p_partkey, p_type, p_name FROM part)
SELECT entity_id, entity_type, name, coalesce(n_out, 0)::BIGINT AS n_out, coalesce(n_in, 0)::BIGINT AS n_in, coalesce(n_literals, 0)::BIGINT AS n_literals, least(o.ev, i.ev) AS evidence
FROM e LEFT JOIN o ON o.e = entity_id LEFT JOIN i ON i.e = entity_id LEFT JOIN l ON l.e = entity_id WHERE n_out IS NOT NULL OR n_in IS NOT NULL OR n_literals IS NOT NULL""")
def active_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that the active publication shows, with their edges, literals and first evidence."""
    s, p = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "part")
    entities = s.select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.lit("Supplier").alias("entity_type"), F.col("s_name").alias("name")).unionByName(
        p.select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("name")))
    facts = F.explode(F.array(F.struct(F.lit("Size").alias("name"), F.col("p_size").cast("string").alias("value")), F.struct(F.lit("Brand").alias("name"), F.col("p_brand").alias("value"))))
    literals = p.filter("p_partkey % 3 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("subject"), facts.alias("f")).select("subject", "f.*")
    return inventory(entities, published(spark, sf_dir)[0].graph(), literals)


@query("""SELECT doc_id, sha256(text) AS version, doc_id % 3 AS batch, CASE WHEN source = 'src3' AND doc_id % 3 <> 2 THEN 'RETIRED' ELSE 'ACTIVE' END AS state FROM documents""")
def document_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents loaded in three batches, of which one comes twice, one is first sent altered and refused, and a source is retired between."""
    docs = load(spark, sf_dir, "documents").select("doc_id", checksum(F.col("text")).alias("version"), (F.col("doc_id") % 3).alias("batch"), "source")
    ledger = Ledger(spark, staging_path(spark, "ledger"))
    batch = lambda k: docs.filter(F.col("batch") == k)
    ledger.load("documents", batch(0), "doc_id", "batch 0")
    ledger.load("documents", batch(0), "doc_id", "batch 0")
    ledger.load("documents", batch(0).unionByName(batch(1)), "doc_id", "batches 0 and 1")
    gone = ledger.table("documents").filter("source = 'src3'")
    ledger.retire("documents", gone, "doc_id", "version", "retire src3")
    for wrong in (batch(1).withColumn("version", F.lit("altered")), gone.withColumn("batch", F.lit(2).cast("long"))):
        try:
            ledger.load("documents", wrong.unionByName(batch(2)), "doc_id", "batch 2")
        except Refused:
            continue  # nothing of it is there
    ledger.load("documents", batch(2), "doc_id", "batch 2")
    alive = ledger.active("documents", "doc_id").select(F.col("doc_id").alias("a_id"))
    return ledger.table("documents").join(alive, F.col("doc_id") == F.col("a_id"), "left").select(
        "doc_id", "version", "batch", F.when(F.col("a_id").isNull(), "RETIRED").otherwise("ACTIVE").alias("state"))


@query("""WITH g AS (SELECT 'supplied' AS generation, count(*) AS total, count(e.vec_id) AS covered FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id UNION ALL SELECT 'derived', count(*), count(*) FROM documents)
SELECT generation, total, covered, generation = 'derived' AS active FROM g""")
def embedding_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations: the supplied vectors, refused as long as documents lack one, and vectors derived for all documents, which is selected."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    supplied = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").join(docs, "chunk_id", "left_semi")
    generations = Generations(Ledger(spark, staging_path(spark, "ledger")))
    generations.prepare("supplied", "given", 64)
    generations.materialize("supplied", supplied, "supplied vectors")
    generations.prepare("derived", "hashed", 8)
    generations.materialize("derived", docs.withColumn("embedding", F.array(*[F.xxhash64(F.lit(k), "chunk_id").cast("float") for k in range(8)])), "derived vectors")
    active = None
    for name in ("supplied", "derived"):
        try:
            generations.activate(name, docs, active)
            active = name
        except Refused:
            continue  # not all documents are covered
    counted = lambda name: docs.join(generations.missing(name, docs).withColumn("lacks", F.lit(1)), "chunk_id", "left").agg(
        F.lit(name).alias("generation"), F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("lacks").isNull(), 1)).alias("covered"), F.lit(name == active).alias("active"))
    return counted("supplied").unionByName(counted("derived"))


@query("""WITH v AS (SELECT doc_id AS node, CASE WHEN doc_id % 10 = 3 THEN source WHEN doc_id % 97 = 0 THEN lang END AS own, doc_id % 970 = 0 AS twice FROM documents),
n AS (SELECT *, last_value(CASE WHEN own IS NOT NULL THEN node END IGNORE NULLS) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS scope FROM v)
SELECT n.node, CASE WHEN n.twice THEN NULL WHEN n.own IS NOT NULL THEN n.own WHEN NOT s.twice THEN s.own END AS value, CASE WHEN NOT n.twice AND n.own IS NOT NULL THEN 'LOCAL' WHEN n.own IS NULL AND NOT s.twice THEN 'INHERITED' ELSE 'MISSING' END AS origin,
  CASE WHEN NOT n.twice AND n.own IS NOT NULL THEN n.node WHEN n.own IS NULL AND NOT s.twice THEN n.scope END AS scope,
  CASE WHEN n.twice OR (n.own IS NULL AND s.twice) THEN 'SCOPE_AMBIGUOUS' WHEN n.own IS NOT NULL AND NOT s.twice AND n.own <> s.own THEN 'LOCAL_CONFLICT' END AS code
FROM n LEFT JOIN v s ON s.node = n.scope""")
def inherited_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of all documents, each below the one before it: values that some of them give hold for all below, until another does."""
    d = load(spark, sf_dir, "documents")
    i = F.col("doc_id")
    nodes = d.select(i.alias("node"), F.when(i > 0, i - 1).alias("parent"))
    given = d.select(i.alias("node"), F.when(i % 10 == 3, F.col("source")).when(i % 97 == 0, F.col("lang")).alias("value"))
    return hierarchies.inherited(nodes, given.unionByName(d.filter(i % 970 == 0).select(i.alias("node"), F.lit("another").alias("value"))))


@query("""WITH RECURSIVE e AS (SELECT doc_id AS node, CASE WHEN doc_id % 100 = 0 THEN NULL WHEN doc_id % 400 BETWEEN 390 AND 399 THEN doc_id - doc_id % 10 + (doc_id + 1) % 10 ELSE doc_id - 1 END AS parent FROM documents)
SELECT node, CASE WHEN node % 400 >= 390 THEN NULL ELSE node - node % 100 END AS root, CASE WHEN node % 400 >= 390 THEN NULL ELSE node % 100 END AS depth, CASE WHEN node % 400 >= 390 THEN 'CYCLE' END AS code FROM e""")
def forest_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of a hundred documents each, of which every fourth ends in a ring of ten: roots and depths, and the ring."""
    i = F.col("doc_id")
    ring = F.when(i % 400 >= 390, i - i % 10 + (i + 1) % 10).otherwise(i - 1)
    found, faults = hierarchies.forest(load(spark, sf_dir, "documents").select(i.alias("node"), F.when(i % 100 != 0, ring).alias("parent")))
    return found.withColumn("code", F.lit(None).cast("string")).unionByName(faults.select("node", F.lit(None).cast("long").alias("root"), F.lit(None).cast("long").alias("depth"), "code"))
