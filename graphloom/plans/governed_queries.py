"""Store writes, rollback, previews, inventories, graph pages, configured mapping and source windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import browse, governed, lifecycle
from graphloom.plans.lifecycle_queries import MANIFESTS, _manifests
from graphloom.plans.registry import query
from graphloom.plans.source_queries import _RECORDS_SQL, _conversations, _json_turn
from graphloom.sources import structured
from graphloom.sources.derived import SUPPLIES_SQL, VERSIONS_SQL, document_versions, supplies
from graphloom.sources.tables import load


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A store with an order's status as content and as many revisions as the order's priority says, and writes on it."""
    o = load(spark, sf_dir, "orders").filter("o_orderkey IS NOT NULL")
    k = F.col("o_orderkey")
    rev = F.substring("o_orderpriority", 1, 1).cast("int")
    stored = o.filter(k % 4 != 0).select(k.cast("string").alias("record_id"), F.explode(F.sequence(F.lit(1), rev)).alias("revision"), F.col("o_orderstatus").alias("content"))
    expected = F.when(k % 4 == 0, F.lit(None).cast("int")).when(k % 5 == 0, rev - 1).otherwise(rev)
    content = F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise("new")
    writes = o.select(k.cast("string").alias("record_id"), expected.alias("expected_revision"), content.alias("content"))
    also = o.filter(k % 7 == 0).select(k.cast("string").alias("record_id"), expected.alias("expected_revision"), F.lit("zz").alias("content"))
    return stored, writes.unionByName(also)


_STORE_SQL = """b AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS record_id, left(o_orderpriority, 1)::INT AS rev, o_orderstatus AS status FROM orders),
w AS (SELECT record_id, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 5 = 0 THEN rev - 1 ELSE rev END AS expected_revision, CASE WHEN k % 3 = 0 THEN status ELSE 'new' END AS content,
    CASE WHEN k % 4 <> 0 THEN rev END AS held, CASE WHEN k % 4 <> 0 THEN status END AS held_content FROM b
  UNION SELECT record_id, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 5 = 0 THEN rev - 1 ELSE rev END, 'zz', CASE WHEN k % 4 <> 0 THEN rev END, CASE WHEN k % 4 <> 0 THEN status END FROM b WHERE k % 7 = 0),
lawful AS (SELECT record_id, min(content) AS content FROM w WHERE content IS DISTINCT FROM held_content AND expected_revision IS NOT DISTINCT FROM held GROUP BY 1),
d AS (SELECT w.*, CASE WHEN w.content = held_content THEN 'REPLAYED' WHEN lawful.content = w.content AND expected_revision IS NOT DISTINCT FROM held THEN 'STORED' ELSE 'REVISION_CONFLICT' END AS outcome FROM w LEFT JOIN lawful USING (record_id))"""


@query(f"WITH {_STORE_SQL} SELECT record_id, expected_revision, content, outcome, CASE outcome WHEN 'STORED' THEN coalesce(held, 0) + 1 WHEN 'REPLAYED' THEN held END AS revision FROM d")
def store_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that expect a revision: stored, replayed or refused."""
    return lifecycle.save(*_store(spark, sf_dir))[1]


@query(f"""WITH {_STORE_SQL} SELECT record_id, max(revision)::INT AS revision FROM (
  SELECT record_id, rev AS revision FROM b WHERE k % 4 <> 0 UNION ALL SELECT record_id, coalesce(held, 0) + 1 FROM d WHERE outcome = 'STORED') GROUP BY 1""")
def store_after_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's last revision when the writes are done."""
    return lifecycle.current(lifecycle.save(*_store(spark, sf_dir))[0]).select("record_id", "revision")


@query(f"""WITH {MANIFESTS} SELECT coalesce(old.record_id, new.record_id) AS record_id, new.revision AS old_revision, old.revision AS new_revision,
CASE WHEN new.record_id IS NULL THEN 'ADDED' WHEN old.record_id IS NULL THEN 'REMOVED' WHEN old.revision = new.revision THEN 'UNCHANGED' ELSE 'CHANGED' END AS change
FROM old FULL JOIN new ON old.record_id = new.record_id""")
def publication_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What going back from the second publication to the first changes."""
    old, new = _manifests(spark, sf_dir)
    publications = old.withColumn("publication_id", F.lit("p1")).unionByName(new.withColumn("publication_id", F.lit("p2")))
    return lifecycle.diff(new, lifecycle.rollback(publications, "p1"))


@query("""WITH m AS (SELECT l_partkey AS e, l_orderkey AS c, l_returnflag AS layer, 'by-' || l_linestatus AS alias FROM lineitem),
ev AS (SELECT e, count(*) AS n_mentions, (list_sort(list(DISTINCT c)))[1:3] AS evidence, list_sort(list(DISTINCT layer)) AS layers, list(DISTINCT alias) AS said FROM m GROUP BY 1)
SELECT p_partkey AS entity_id, list_sort(list_distinct([p_brand, p_type] || coalesce(said, []))) AS aliases, coalesce(layers, []) AS layers, coalesce(evidence, []) AS evidence, coalesce(n_mentions, 0) AS n_mentions,
  ['Mark=' || array_to_string(list_sort(list_distinct([p_brand, p_type])), '|'), 'Size=' || p_size] AS properties FROM part LEFT JOIN ev ON e = p_partkey""")
def instance_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a reader would see it: names, layers, first evidence, properties."""
    p, l = load(spark, sf_dir, "part"), load(spark, sf_dir, "lineitem")
    key = F.col("p_partkey").alias("entity_id")
    facts = p.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for n, c in (("Mark", "p_brand"), ("Mark", "p_type"), ("Size", "p_size"))])).alias("f")).select("entity_id", "f.*")
    mentions = l.select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_returnflag").alias("layer"), F.concat(F.lit("by-"), "l_linestatus").alias("alias"))
    return governed.entity_views(p.select(key, F.array("p_brand", "p_type").alias("aliases")), mentions, facts)


@query(f"""WITH {SUPPLIES_SQL}, e AS (SELECT 's' || subject || '>p' || object AS key, 's' || subject AS a, 'p' || object AS b FROM supplies),
d1 AS (SELECT b AS node FROM e WHERE a = 's3'), d AS (SELECT 's3' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1),
x AS (SELECT 'relationship' AS kind, key, min(depth) AS depth, 0 AS r FROM e JOIN d ON node IN (a, b) GROUP BY key
  UNION ALL SELECT 'property', 'p' || p_partkey || '.Size', depth, 1 FROM part JOIN d ON node = 'p' || p_partkey UNION ALL SELECT 'node', node, depth, 2 FROM d)
SELECT (row_number() OVER (ORDER BY depth, r, key))::INT AS place, kind, key, depth, count(*) OVER () > 150 AS has_more FROM x QUALIFY place <= 150""")
def graph_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page around a supplier: its relationships, then properties and nodes, nearest first."""
    s = supplies(spark, sf_dir)
    a, b = F.concat(F.lit("s"), "subject"), F.concat(F.lit("p"), "object")
    edges = s.select(F.concat(a, F.lit(">"), b).alias("key"), a.alias("source"), b.alias("target"))
    depths = browse.neighbourhood(edges, spark.createDataFrame([("s3",)], "node string"), hops=1)
    literals = load(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit(".Size")).alias("key"), F.concat(F.lit("p"), "p_partkey").alias("node"))
    return governed.graph_page(edges, literals, depths.select("node"), depths, 150)


@query("SELECT l_returnflag AS layer, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def trust_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that the strict policy admits: finished lines are authoritative."""
    l = load(spark, sf_dir, "lineitem").withColumn("authority", F.when(F.col("l_linestatus") == "F", "AUTHORITATIVE").otherwise("SECONDARY"))
    return governed.trusted(l, "AUTHORITATIVE_ONLY").groupBy(F.col("l_returnflag").alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(octet_length(encode(text))) > 100000 AS over_budget, list_sort(list(DISTINCT lang)) AS languages FROM documents GROUP BY source")
def source_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each source against a budget, and the union of its documents' language lists."""
    d = load(spark, sf_dir, "documents").groupBy("source")
    size = F.sum(F.octet_length("text"))
    return d.agg(size.alias("bytes"), (size > 100_000).alias("over_budget"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("lang"))))).alias("languages"))


WANTED = [77, 3, 500, 3, 12, 999_999_999, 41]


@query(f"SELECT position::INT AS position, doc_id, lang FROM (SELECT unnest({WANTED}) AS doc_id, generate_subscripts({WANTED}, 1) - 1 AS position) w JOIN documents USING (doc_id)")
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order in which they are asked for."""
    return governed.in_request_order(load(spark, sf_dir, "documents").select("doc_id", "lang"), WANTED, "doc_id").select("position", "doc_id", "lang")


@query("SELECT doc_id, n_chars, true AS overflow FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30")
def overflow_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty longest documents, and whether there are more."""
    return governed.probed(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 30)


@query("""WITH a AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 2 = 0 OR lang = 'en'), b AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 3 = 0 OR lang = 'fr')
SELECT coalesce(a.source, b.source) AS source, coalesce(a.lang, b.lang) AS lang, CASE WHEN a.source IS NULL THEN 'ADDED' WHEN b.source IS NULL THEN 'REMOVED' ELSE 'KEPT' END AS change
FROM a FULL JOIN b ON a.source = b.source AND a.lang = b.lang""")
def scope_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which (source, language) scopes one publication has and the other lacks."""
    d = load(spark, sf_dir, "documents").withColumn("record_id", F.concat_ws("|", "source", "lang")).withColumn("revision", F.lit(1))
    scope = lambda when: d.filter(when).select("record_id", "revision").distinct()
    found = lifecycle.diff(scope("doc_id % 2 = 0 OR lang = 'en'"), scope("doc_id % 3 = 0 OR lang = 'fr'"))
    parts = F.split("record_id", "\\|")
    return found.select(parts[0].alias("source"), parts[1].alias("lang"), F.when(F.col("change") == "UNCHANGED", "KEPT").otherwise(F.col("change")).alias("change"))


@query(f"""WITH {VERSIONS_SQL}, x AS (SELECT document_id, lifecycle, access_groups[1] AS source FROM versions)
SELECT document_id, EXISTS (FROM embeddings WHERE vec_id = document_id) AS blocked_by_vector, EXISTS (FROM labels WHERE doc_id = document_id) AS blocked_by_review,
  EXISTS (FROM lineitem WHERE l_orderkey = document_id) AS blocked_by_mention, EXISTS (FROM versions v WHERE v.document_id = x.document_id + 1 AND v.lifecycle = 'RETIRED') AS blocked_by_successor
FROM x WHERE coalesce(lifecycle, 'ACTIVE') = 'ACTIVE'""")
def active_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active documents, and what stands against retiring each."""
    v = document_versions(spark, sf_dir).select("document_id", "lifecycle")
    out = v.filter(F.coalesce("lifecycle", F.lit("ACTIVE")) == "ACTIVE").select("document_id")
    blocks = {
        "vector": load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k")), "review": load(spark, sf_dir, "labels").select(F.col("doc_id").alias("k")),
        "mention": load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "successor": v.filter("lifecycle = 'RETIRED'").select((F.col("document_id") - 1).alias("k")),
    }
    for name, keys in blocks.items():
        out = out.join(keys.distinct(), F.col("document_id") == F.col("k"), "left").withColumn(f"blocked_by_{name}", F.col("k").isNotNull()).drop("k")
    return out


def _json_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir, _json_turn(), '{"turns": [', ", ", "]}")


@query(f"""WITH {_RECORDS_SQL},
f AS (SELECT doc_id, i, s, s + length(j) AS e, 'Turn' AS name, turn::VARCHAR AS value, s + 9 AS vs FROM p UNION ALL SELECT doc_id, i, s, s + length(j), 'Speaker', '"' || role || '"', s + 19 + length(turn::VARCHAR) FROM p
  UNION ALL SELECT doc_id, i, s, s + length(j), 'Length', n::VARCHAR, s + length(j) - 6 - length(n::VARCHAR) FROM p UNION ALL SELECT doc_id, i, s, s + length(j), 'Mood', NULL, NULL FROM p)
SELECT doc_id, i::INT AS record, s::INT AS record_start, e::INT AS record_end, name, value, vs::INT AS value_start, (vs + length(value))::INT AS value_end FROM f""")
def mapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' JSON records by a table of fields, each value with its place; no record has a mood."""
    docs = _json_conversations(spark, sf_dir)
    fields = [governed.Field("/turn", "Turn"), governed.Field("/role", "Speaker"), governed.Field("/sizes/0", "Length"), governed.Field("/mood", "Mood")]
    return governed.map_records(structured.locate_json(docs), docs, "/turns", fields)


@query(f"""WITH {_RECORDS_SQL} SELECT doc_id AS id, '/turns/' || i || t.tail AS path, CASE WHEN i = 0 THEN '/turns' ELSE '/turns/' || i END AS ancestor FROM p, (VALUES ('/turn'), ('/role'), ('/sizes'), ('/sizes/0'), ('/sizes/1')) t(tail)
UNION ALL SELECT doc_id, '/turns/' || i, '/turns' FROM p UNION ALL SELECT DISTINCT doc_id, '/turns', NULL FROM p UNION ALL SELECT DISTINCT doc_id, '', NULL FROM p""")
def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each node of each conversation's JSON the nearest mapped one above it; lists of turns and all turns but the first are mapped."""
    nodes = structured.locate_json(_json_conversations(spark, sf_dir)).select(F.col("doc_id").alias("id"), F.col("pointer").alias("path"))
    mapped = nodes.filter((F.col("path") == "/turns") | (F.col("path").rlike(r"^/turns/\d+$") & (F.col("path") != "/turns/0")))
    return governed.nearest_ancestors(nodes, mapped)


def _start(width: str) -> str:
    """Where a window of that width starts, in SQL, for the terms of ``TERMS``."""
    out = "0"
    for t in reversed(TERMS):
        hit = f"(strpos(text, m_{t}) + (NOT starts_with(lower(m_{t}), '{t}'))::INT)"
        out = f"CASE WHEN m_{t} <> '' AND {len(t)} <= {width} THEN greatest(0, {hit} - 1 - ({width} - {len(t)}) // 2) ELSE {out} END"
    return f"least({out}, greatest(length(text) - {width}, 0))"


TERMS = ["zzzz", "est", "the"]
_HITS = ", ".join(f"regexp_extract(text, '(?i)(^|[^A-Za-z0-9_]){t}($|[^A-Za-z0-9_])') AS m_{t}" for t in TERMS)


@query(f"WITH h AS (SELECT doc_id, text, {_HITS} FROM documents) SELECT doc_id, substring(text, {_start('200')} + 1, 200) AS excerpt FROM h")
def source_window_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred characters around the first of several terms that stands in the text as a word."""
    text = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.substring(text, governed.window_start(text, TERMS, F.lit(200)) + 1, F.lit(200)).alias("excerpt"))


@query(f"""WITH RECURSIVE h AS (SELECT doc_id, text, {_HITS} FROM documents),
s AS (SELECT *, 1 AS low, least(length(text) - 1, 240)::INT AS high, 1 AS width, 0 AS turn FROM h
  UNION ALL SELECT doc_id, text, {", ".join(f"m_{t}" for t in TERMS)}, CASE WHEN fine THEN mid + 1 ELSE low END, CASE WHEN fine THEN high ELSE mid - 1 END, CASE WHEN fine THEN mid ELSE width END, turn + 1
  FROM (SELECT *, strlen(substring(text, {_start('mid')} + 1, mid)) <= 240 AS fine FROM (SELECT *, ((low + high) // 2)::INT AS mid FROM s WHERE low <= high)))
SELECT doc_id, CASE WHEN strlen(text) <= 240 THEN text ELSE substring(text, {_start('width')} + 1, width) END AS excerpt FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY turn DESC) = 1""")
def byte_bounded_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest such window of at most 240 bytes."""
    return load(spark, sf_dir, "documents").select("doc_id", governed.byte_bounded_window(F.col("text"), TERMS, 240).alias("excerpt"))
