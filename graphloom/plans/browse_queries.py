"""Graph browsing and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import browse
from graphloom.plans.registry import query
from graphloom.sources.derived import SUPPLIES_SQL, supplies
from graphloom.sources.tables import load


@query("""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem),
w AS (SELECT source, target FROM e UNION ALL SELECT target, source FROM e),
h1 AS (SELECT DISTINCT target AS node FROM w WHERE source IN ('s1', 's2')),
h2 AS (SELECT DISTINCT target AS node FROM w WHERE source IN (SELECT node FROM h1)),
a AS (SELECT 's1' AS node, 0 AS depth UNION ALL SELECT 's2', 0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2)
SELECT node, min(depth) AS depth FROM a GROUP BY 1""")
def neighborhood_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops from two suppliers over all deliveries."""
    l = load(spark, sf_dir, "lineitem")
    edges = l.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")).distinct()
    return browse.neighbourhood(edges, spark.createDataFrame([("s1",), ("s2",)], "node string"))


@query("SELECT p_partkey AS entity_id, p_name AS name, p_type AS entity_type FROM part ORDER BY p_name, p_partkey OFFSET 40 LIMIT 20")
def inventory_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"))
    return browse.page(p, [F.col("name"), F.col("entity_id")], 40, 20)


@query("SELECT lang, doc_id, source FROM documents WHERE (lang, doc_id) > ('en', 100) ORDER BY lang, doc_id LIMIT 25")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.after(load(spark, sf_dir, "documents").select("lang", "doc_id", "source"), ["lang", "doc_id"], ("en", 100), 25)


@query("SELECT p_partkey AS entity_id, p_name AS name FROM part ORDER BY p_partkey OFFSET (SELECT count(*) // 30 * 30 FROM part WHERE p_partkey < 123) LIMIT 30")
def focus_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    return browse.page_of(p, "entity_id", 123, 30)


@query("""SELECT p_partkey AS entity_id, 1 + (p_size > 25)::BIGINT + (p_retailprice > 1000)::BIGINT AS property_count, count(DISTINCT l_suppkey) AS relation_count FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2""")
def entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties (every part has a brand, large ones a size class, dear ones a price class) and distinct relations of each part."""
    p = load(spark, sf_dir, "part")
    held = F.array_compact(F.array(F.lit("Brand"), F.when(F.col("p_size") > 25, "Large"), F.when(F.col("p_retailprice") > 1000, "Dear")))
    facts = p.select(F.col("p_partkey").alias("f_id"), F.explode(held)).groupBy("f_id").agg(F.count(F.lit(1)).alias("property_count"))
    edges = supplies(spark, sf_dir).groupBy(F.col("object").alias("e_id")).agg(F.count(F.lit(1)).alias("relation_count"))
    return p.select(F.col("p_partkey").alias("entity_id")).join(facts, F.col("entity_id") == F.col("f_id"), "left").join(
        edges, F.col("entity_id") == F.col("e_id"), "left"
    ).select("entity_id", "property_count", F.coalesce("relation_count", F.lit(0)).alias("relation_count"))


@query("SELECT l_suppkey AS subject, l_partkey AS object, count(*) AS n_evidence, min(l_orderkey * 10 + l_linenumber) AS first_evidence, list_sort(list(DISTINCT l_returnflag)) AS layers FROM lineitem GROUP BY 1, 2")
def relationship_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions of one fact together: how many sources, the first, and their layers."""
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("object")).agg(
        F.count(F.lit(1)).alias("n_evidence"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_evidence"),
        F.array_sort(F.collect_set("l_returnflag")).alias("layers"),
    )


@query("SELECT l_suppkey AS subject, l_partkey AS object, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) AS evidence FROM lineitem WHERE l_suppkey IN (1, 2, 3) GROUP BY 1, 2")
def evidence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first evidence of the assertions of a few subjects."""
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "subject long")
    l = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("object"), "l_orderkey", "l_linenumber")
    return l.join(F.broadcast(wanted), "subject", "left_semi").groupBy("subject", "object").agg(
        F.min_by("l_orderkey", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence")
    )


@query("""WITH b AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS band FROM (SELECT DISTINCT p_type FROM part)),
n AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS n FROM part)
SELECT p_partkey, n.p_type, (n % 10 * 100)::INT AS x, (band * 10000 + n // 10 * 100)::INT AS y FROM n JOIN b ON n.p_type = b.p_type""")
def layout_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.grid(load(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "p_partkey")


@query("SELECT p_partkey AS entity_id, p_name AS name FROM part WHERE contains(lower(p_name || ' ' || p_brand), '1')")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.filter(F.lower(F.concat_ws(" ", "p_name", "p_brand")).contains("1")).select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))


@query(f"""WITH {SUPPLIES_SQL}, m AS (SELECT DISTINCT l_partkey AS e FROM lineitem WHERE l_orderkey <= 30)
SELECT subject, object, row_number() OVER (PARTITION BY object ORDER BY subject)::INT AS position FROM supplies WHERE object IN (SELECT e FROM m) QUALIFY position <= 3""")
def evidence_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions that touch an entity mentioned in the selected chunks, three an entity at most."""
    from pyspark.sql import Window

    seeds = load(spark, sf_dir, "lineitem").filter("l_orderkey <= 30").select(F.col("l_partkey").alias("object")).distinct()
    order = Window.partitionBy("object").orderBy("subject")
    return supplies(spark, sf_dir).join(seeds, "object", "left_semi").select("subject", "object", F.row_number().over(order).alias("position")).filter("position <= 3")
