"""A configured mapping over conversations written as XML, some with faults of one kind each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import xml_mapping
from graphloom.plans.registry import query
from graphloom.sources import structured
from graphloom.sources.tables import load
from graphloom.staging import kept
from graphloom.store import table_version

MAPPING = {
    "collections": [
        {"id": "talk", "select": ["/talks"], "type": "Talk", "identity": {"fields": ["@version"]}, "properties": []},
        {"id": "person", "select": ["/talks//p"], "identity": {"fields": ["@id"]}, "properties": [],
         "type": [{"when": {"@k": k}, "entity_type": t} for k, t in (("h", "Human"), ("m", "Model"), ("s", "System"))]},
        {"id": "turn", "select": ["/talks/turn"], "type": "Turn", "identity": {"owner": "talk", "fields": ["@n"]}, "retained": ["note/@lang"],
         "properties": [{"select": "size/text()", "property": "Size", "transform": "quantity", "unit": "c"},
                        {"select": "tone[@kind='main']/text()", "property": "Tone", "transform": "enum", "values": {"a": "calm", "b": "bright"}}]},
    ],
    "relationships": [
        {"type": "HAS", "kind": "parent", "from": "talk", "to": "turn"},
        {"type": "SAID_BY", "kind": "reference", "from": "turn", "to": "person", "select": "@who", "target_select": "@id"},
    ],
    "deferred": [{"type": "SAID_BY", "collection": "turn"}],
}
TYPES = {"Talk": {}, "Human": {}, "Model": {}, "System": {}, "Turn": {"Size": True, "Tone": False}}
RELATIONS = {"HAS": [("Talk", "Turn")], "SAID_BY": [("Turn", "Human"), ("Turn", "Model")]}
#: What follows the turns, by the conversation's id: all there, one person twice, one missing, one of no known kind.
_PEOPLE = ('<p id="system" k="s"/><p id="user" k="h"/><p id="assistant" k="m"/>', '<p id="system" k="s"/><p id="user" k="h"/><p id="user" k="h"/><p id="assistant" k="m"/>',
           '<p id="system" k="s"/><p id="user" k="h"/>', '<p id="system" k="s"/><p id="user" k="z"/><p id="assistant" k="m"/>')


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    row = F.format_string(
        '<turn n="%d" who="%s"><size>%d %s</size><tone kind="side">b</tone><tone kind="main">%s</tone><note lang="en"/></turn>', turn, "role", F.length("text"),
        F.when(F.length("text") % 5 == 0, "x").otherwise("c"), F.when(turn % 3 == 0, "a").when(turn % 3 == 1, "b").otherwise("?"))
    c = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", row.alias("row")))).alias("rows"))
    people = F.array(*[F.lit(x) for x in _PEOPLE])[(F.col("doc_id") % 4).cast("int")]
    text = F.concat(F.lit('<talks version="1">'), F.array_join(F.col("rows.row"), ""), F.lit("<people>"), people, F.lit("</people></talks>"))
    return c.select("doc_id", F.when(F.col("doc_id") % 13 == 5, F.concat(text, F.lit("<"))).otherwise(text).alias("text"))


def _mapped(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The mapping's results: made once in an application and state of the table, for all that look at them."""

    def make() -> dict[str, DataFrame]:
        nodes = structured.locate_xml(_sources(spark, sf_dir)).select("doc_id", "path", "kind", "value", "char_start", "char_end")
        return xml_mapping.map_xml(nodes, MAPPING, TYPES, RELATIONS)

    return kept(("xml", spark.sparkContext.applicationId, sf_dir, table_version(load(spark, sf_dir, "conversations"))), make)


_SHA = """'xml:' || sha256('{{"collection":"{}","parts":["' || {} || '"]}}')"""
SQL = f"""t AS (SELECT conv_id AS id, turn, role, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE conv_id % 13 <> 5),
d AS (SELECT DISTINCT id FROM t), talk AS (SELECT id, 'talk' AS collection, '/talks' AS path, 'Talk' AS entity_type, {_SHA.format("talk", "'1'")} AS identity FROM d),
turn AS (SELECT id, 'turn' AS collection, '/talks/turn[' || i || ']' AS path, 'Turn' AS entity_type, {_SHA.format("turn", "(" + _SHA.format("talk", "'1'") + ") || '" + '","' + "' || turn")} AS identity, turn, role, size FROM t),
p AS (SELECT id, v.role, v.k, '/talks/people[1]/p[' || row_number() OVER (PARTITION BY id ORDER BY o) || ']' AS path FROM d, (VALUES ('system', 's', 1), ('user', 'h', 2), ('user', 'h', 3), ('assistant', 'm', 4)) v(role, k, o)
  WHERE (o <> 3 OR id % 4 = 1) AND NOT (o = 4 AND id % 4 = 2)),
person AS (SELECT id, 'person' AS collection, path, CASE k WHEN 'h' THEN 'Human' WHEN 'm' THEN 'Model' ELSE 'System' END AS entity_type, {_SHA.format("person", "role")} AS identity, role FROM p WHERE NOT (role = 'user' AND id % 4 IN (1, 3))),
fine_size AS (FROM turn WHERE size % 5 <> 0), fine_tone AS (FROM turn WHERE turn % 3 <> 2)"""


@query(f"WITH {SQL} FROM talk UNION ALL SELECT id, collection, path, entity_type, identity FROM turn UNION ALL SELECT id, collection, path, entity_type, identity FROM person")
def xml_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each source: talks, their turns and the people, with identities scoped by their owners."""
    return _mapped(spark, sf_dir)["entities"]


@query(f"""WITH {SQL} SELECT id, identity, 'Size' AS property, size::VARCHAR AS value, 'c' AS unit, path || '/size[1]' AS path FROM fine_size
UNION ALL SELECT id, identity, 'Tone', CASE turn % 3 WHEN 0 THEN 'calm' ELSE 'bright' END, NULL, path || '/tone[2]' FROM fine_tone""")
def xml_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed properties: a quantity with its unit, and a code by its table of values; the tone is chosen by a predicate."""
    return _mapped(spark, sf_dir)["properties"]


@query(f"""WITH {SQL} SELECT turn.id, 'HAS' AS type, talk.identity AS source, turn.identity AS target, 'parent' AS basis FROM turn JOIN talk USING (id)
UNION ALL SELECT turn.id, 'SAID_BY', turn.identity, person.identity, 'reference' FROM turn JOIN person ON person.id = turn.id AND person.role = turn.role WHERE person.entity_type <> 'System'""")
def xml_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by the nearest record above and by references; none is guessed."""
    return _mapped(spark, sf_dir)["relationships"]


@query(f"""WITH {SQL} SELECT id, code, count(*) AS n FROM (SELECT DISTINCT conv_id AS id, 'XML_SOURCE_INVALID' AS code FROM conversations WHERE conv_id % 13 = 5
  UNION ALL SELECT id, 'XML_IDENTITY_DUPLICATE' FROM p WHERE id % 4 = 1 AND role = 'user' UNION ALL SELECT id, 'XML_TYPE_UNMAPPED' FROM p WHERE id % 4 = 3 AND role = 'user'
  UNION ALL SELECT id, 'XML_QUANTITY_INVALID' FROM turn WHERE size % 5 = 0 UNION ALL SELECT id, 'XML_REQUIRED_PROPERTY_MISSING' FROM turn WHERE size % 5 = 0 UNION ALL SELECT id, 'XML_ENUM_UNMAPPED' FROM turn WHERE turn % 3 = 2
  UNION ALL SELECT id, 'XML_REFERENCE_UNRESOLVED' FROM turn WHERE (role = 'user' AND id % 4 IN (1, 3)) OR (role = 'assistant' AND id % 4 = 2) UNION ALL SELECT id, 'XML_RELATIONSHIP_ENDPOINT_INVALID' FROM turn WHERE role = 'system'
  UNION ALL SELECT id, 'XML_SEMANTIC_BINDING_DEFERRED' FROM d) GROUP BY ALL""")
def xml_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source's mapping says is wrong or open, counted."""
    return _mapped(spark, sf_dir)["diagnostics"].groupBy("id", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SQL}, f AS (SELECT id, 'binding' AS disposition FROM d UNION ALL SELECT id, CASE WHEN k = 'h' AND id % 4 = 3 THEN 'unmapped' ELSE 'binding' END FROM p UNION ALL SELECT id, 'binding' FROM p
  UNION ALL SELECT id, unnest(['binding', 'binding', CASE WHEN size % 5 = 0 THEN 'unmapped' ELSE 'mapped' END, CASE WHEN turn % 3 = 2 THEN 'unmapped' ELSE 'mapped' END, 'unmapped', 'unmapped', 'unmapped', 'retained']) FROM turn)
SELECT id, disposition, count(*) AS n FROM f GROUP BY ALL""")
def xml_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each source's attributes and texts are mapped, binding, retained or unmapped."""
    return _mapped(spark, sf_dir)["coverage"].groupBy("id", "disposition").agg(F.count(F.lit(1)).alias("n"))
