"""Records to graph: JSON, XML and literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import literals
from graphloom.operators import lifecycle
from graphloom.plans.registry import query
from graphloom.sources.tables import load


@query("SELECT event_id, 'event:' || event_id AS record_id, event_type AS entity_type, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of JSON records, read through VARIANT."""
    v = F.try_parse_json("props")
    return load(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("event:"), "event_id").alias("record_id"), F.col("event_type").alias("entity_type"), F.try_variant_get(v, "$.k", "bigint").alias("k")
    )


@query("SELECT k AS path, count(*) AS n_records, count(DISTINCT props::JSON ->> '$.k') AS n_values FROM (SELECT props, unnest(json_keys(props::JSON)) AS k FROM events) GROUP BY 1")
def json_field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the JSON records, in how many records it is, and its number of values."""
    kept = load(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))
    return kept.groupBy("path").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("value").alias("n_values"))


@query(r"""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language, length(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title_chars,
len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n_links, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs FROM pages""")
def page_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, title, links and paragraphs of raw pages (which are not well-formed XML)."""
    html = F.col("html")
    return load(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("language"),
        F.length(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)).cast("long").alias("title_chars"),
        F.size(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"),
        F.size(F.regexp_extract_all(html, F.lit("(<p[ >])"), F.lit(1))).cast("long").alias("n_paragraphs"),
    )


@query("SELECT o_orderkey AS record_id, count(l_linenumber) AS n_lines, min(l_linenumber) AS first_line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def xml_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as XML records, mapped by XPath."""
    l = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.format_string("<line n='%d'/>", "l_linenumber"))).alias("lines")
    )
    o = load(spark, sf_dir, "orders").select("o_orderkey").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    xml = o.select("o_orderkey", F.concat(F.lit("<order>"), F.coalesce(F.array_join("lines", ""), F.lit("")), F.lit("</order>")).alias("xml"))
    first = F.expr("array_min(transform(xpath(xml, '/order/line/@n'), x -> int(x)))")
    return xml.select(F.col("o_orderkey").alias("record_id"), F.xpath_int("xml", F.lit("count(/order/line)")).cast("long").alias("n_lines"), first.alias("first_line"))


@query(r"""WITH v AS (SELECT event_id, event_id % 14 AS kind, value, ts FROM events),
r AS (SELECT event_id, kind, CASE kind WHEN 0 THEN value::VARCHAR WHEN 1 THEN 'True' WHEN 2 THEN '2024-02-' || lpad((event_id % 40)::VARCHAR, 2, '0') WHEN 3 THEN 'yes' WHEN 4 THEN ' 007 '
   WHEN 5 THEN CASE WHEN event_id % 28 < 14 THEN 'https://a.example/' || event_id ELSE 'https://a.example/ ' || event_id END WHEN 6 THEN '+' || event_id WHEN 7 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:30'
   WHEN 8 THEN 'P' || event_id || 'DT5M' WHEN 9 THEN '-0.' || event_id || '00' WHEN 10 THEN '{"b": ' || event_id || ', "a": [1, 2]}' WHEN 11 THEN 'P5X'
   WHEN 12 THEN event_id || 'e-19' ELSE '-' || event_id || '.50E+40' END AS raw, value, ts FROM v)
SELECT event_id, ['FLOAT','BOOLEAN','DATE','BOOLEAN','INTEGER','URI','INTEGER','DATETIME','DURATION','DECIMAL','JSON','DURATION','FLOAT','DECIMAL'][kind + 1] AS datatype,
 CASE kind WHEN 0 THEN CASE WHEN strpos(raw, '.') > 0 THEN regexp_replace(regexp_replace(raw, '0+$', ''), '\.$', '') ELSE raw END WHEN 1 THEN 'true'
 WHEN 2 THEN try_cast(raw AS DATE)::VARCHAR WHEN 5 THEN CASE WHEN strpos(raw, ' ') = 0 THEN raw END WHEN 6 THEN event_id::VARCHAR
 WHEN 7 THEN strftime(date_trunc('second', ts) - INTERVAL 150 MINUTE, '%Y-%m-%dT%H:%M:%SZ') WHEN 8 THEN raw WHEN 9 THEN '-0.' || regexp_replace(event_id::VARCHAR, '0+$', '')
 WHEN 10 THEN '{"a":[1,2],"b":' || event_id || '}'
 WHEN 12 THEN CASE event_id WHEN 0 THEN '0' ELSE regexp_replace('0.' || lpad(event_id::VARCHAR, 19, '0'), '0+$', '') END
 WHEN 13 THEN '-' || ltrim(event_id || '50', '0') || repeat('0', 38) END AS canonical FROM r""")
def literal_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical text of typed values; null where the value is not of its type or has blanks at its edges."""
    i, text = F.col("event_id"), lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    kinds = (
        ("FLOAT", F.col("value").cast("string")), ("BOOLEAN", F.lit("True")), ("DATE", text("2024-02-", F.lpad((i % 40).cast("string"), 2, "0"))),
        ("BOOLEAN", F.lit("yes")), ("INTEGER", F.lit(" 007 ")), ("URI", text("https://a.example/", F.when(i % 28 < 14, "").otherwise(" "), i)),
        ("INTEGER", text("+", i)), ("DATETIME", text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "+02:30")), ("DURATION", text("P", i, "DT5M")),
        ("DECIMAL", text("-0.", i, "00")), ("JSON", text('{"b": ', i, ', "a": [1, 2]}')), ("DURATION", F.lit("P5X")),
        ("FLOAT", text(i, "e-19")), ("DECIMAL", text("-", i, ".50E+40")),
    )
    raw, datatype = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, value) in enumerate(kinds):
        raw, datatype = F.when(i % len(kinds) == k, value).otherwise(raw), F.when(i % len(kinds) == k, name).otherwise(datatype)
    v = load(spark, sf_dir, "events").select("event_id", raw.alias("raw"), datatype.alias("datatype"))
    return v.select("event_id", "datatype", literals.canonical(F.col("raw"), F.col("datatype")).alias("canonical"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE l_returnflag WHEN 'A' THEN l_quantity * 1000 WHEN 'R' THEN l_quantity * 0.01 ELSE l_quantity END, 6) AS metres FROM lineitem""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in kilometres, centimetres or metres, by a table of units."""
    l = load(spark, sf_dir, "lineitem").withColumn("unit", F.when(F.col("l_returnflag") == "A", "km").when(F.col("l_returnflag") == "R", "cm").otherwise("m"))
    return literals.to_base_unit(l, "l_quantity", "unit").select("l_orderkey", "l_linenumber", F.round("base_value", 6).cast("double").alias("metres"))


@query("""WITH p AS (SELECT c_custkey, c_mktsegment AS own, CASE WHEN n_regionkey = 0 THEN NULL ELSE 'R' || n_regionkey END AS inherited FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey AS entity_id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN own END, inherited) AS value,
CASE WHEN c_custkey % 2 = 0 AND inherited IS NOT NULL THEN 'LOCAL_WINS' WHEN c_custkey % 2 = 0 THEN 'LOCAL' WHEN inherited IS NOT NULL THEN 'INHERITED' ELSE 'MISSING' END AS origin FROM p""")
def context_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property inherited from the scope above unless the record has its own."""
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    scope = n.select("n_nationkey", F.when(F.col("n_regionkey") != 0, F.concat(F.lit("R"), "n_regionkey")).alias("inherited"))
    own = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    both = c.join(scope, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("own", own)
    origin = (
        F.when(F.col("own").isNotNull() & F.col("inherited").isNotNull(), "LOCAL_WINS").when(F.col("own").isNotNull(), "LOCAL")
        .when(F.col("inherited").isNotNull(), "INHERITED").otherwise("MISSING")
    )
    return both.select(F.col("c_custkey").alias("entity_id"), F.coalesce("own", "inherited").alias("value"), origin.alias("origin"))


@query("""WITH m AS (SELECT event_id, event_type, (props::JSON ->> '$.k')::BIGINT AS k FROM events),
s AS (SELECT event_id, event_type, k + (event_id % 97 = 0)::BIGINT AS k FROM m WHERE event_id % 89 <> 0 UNION ALL SELECT event_id, event_type, k FROM m WHERE event_id % 83 = 0),
a AS (SELECT * FROM m EXCEPT ALL SELECT * FROM s), b AS (SELECT * FROM s EXCEPT ALL SELECT * FROM m)
SELECT event_id, 'missing' AS problem, count(*) AS n FROM a GROUP BY 1 UNION ALL SELECT event_id, 'unexpected', count(*) FROM b GROUP BY 1""")
def mapped_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows, some of them altered, lost or stored twice, against those that mapping the sources again gives."""
    mapped = json_mapping(spark, sf_dir).select("event_id", F.col("entity_type").alias("event_type"), "k")
    i = F.col("event_id")
    kept = mapped.filter(i % 89 != 0).withColumn("k", F.col("k") + (i % 97 == 0).cast("long"))
    return lifecycle.replay(mapped, kept.unionByName(mapped.filter(i % 83 == 0)), "event_id")
