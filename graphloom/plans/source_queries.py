"""Reading, locating and cutting sources; their SQL knows how each source was put together, and parses nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import checksum
from graphloom.operators import chunking
from graphloom.plans.corpus_queries import _CUT_LINES
from graphloom.plans.registry import query
from graphloom.sources import parsing, structured
from graphloom.sources.tables import load


@query("""WITH s AS (SELECT doc_id, text, doc_id % 10 AS k, encode(text) AS raw FROM documents),
b AS (SELECT doc_id, k, text, CASE k WHEN 1 THEN unhex('EFBBBF') || raw WHEN 2 THEN encode(replace(text, chr(10), chr(13) || chr(10))) WHEN 3 THEN raw || unhex('FF')
  WHEN 4 THEN raw || unhex('07') WHEN 5 THEN ''::BLOB WHEN 6 THEN encode('  ' || chr(10)) ELSE raw END AS payload,
  CASE k WHEN 3 THEN 'UTF8_INVALID' WHEN 4 THEN 'CONTROL_CHARACTER' WHEN 5 THEN 'EMPTY' WHEN 6 THEN 'BLANK' WHEN 7 THEN 'MEDIA_UNSUPPORTED' WHEN 8 THEN 'CHARSET_UNSUPPORTED' END AS problem FROM s)
SELECT doc_id, CASE k WHEN 7 THEN 'image/png' WHEN 8 THEN NULL ELSE 'text/plain' END AS media, sha256(payload) AS original_checksum,
  CASE WHEN problem IS NULL THEN sha256(nfc_normalize(text)) END AS checksum, problem FROM b""")
def source_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads: some with a byte order mark, other newlines, bad bytes, controls, nothing, or an unknown type."""
    kind = F.col("doc_id") % 10
    raw = F.col("text").cast("binary")
    payload = (
        F.when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw)).when(kind == 2, F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")).cast("binary"))
        .when(kind == 3, F.concat(raw, F.unhex(F.lit("FF")))).when(kind == 4, F.concat(raw, F.unhex(F.lit("07")))).when(kind == 5, F.lit("").cast("binary"))
        .when(kind == 6, F.lit("  \n").cast("binary")).otherwise(raw)
    )
    declared = F.when(kind == 7, "Image/PNG").when(kind == 8, "text/plain; charset=latin-1").when(kind == 9, 'Text/Plain; charset="UTF-8"').otherwise("text/plain")
    sources = load(spark, sf_dir, "documents").select("doc_id", payload.alias("payload"), declared.alias("mime_type"))
    return parsing.parse_sources(sources).select("doc_id", "media", "original_checksum", "checksum", "problem")


@query("""SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'JSON_DUPLICATE_KEY' WHEN 2 THEN 'JSON_CONSTANT' WHEN 3 THEN CASE WHEN 2 + event_id % 100 > 64 THEN 'JSON_DEPTH_LIMIT' END
  WHEN 4 THEN CASE WHEN 1 + event_id % 90 > 70 THEN 'JSON_NODE_LIMIT' END WHEN 5 THEN 'JSON_INVALID' END AS problem FROM events""")
def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties as they are, and with repeated keys, NaN, nesting, many nodes or an end missing."""
    i = F.col("event_id")
    deep = F.concat(F.repeat(F.lit("["), (i % 100).cast("int")), "props", F.repeat(F.lit("]"), (i % 100).cast("int")))
    wide = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("1"), (i % 90).cast("int")), ","), F.lit("]"))
    text = (
        F.when(i % 8 == 1, F.concat(F.lit('{"a": 1, "b": '), "props", F.lit(', "a": 2}'))).when(i % 8 == 2, F.lit('{"a": NaN}'))
        .when(i % 8 == 3, deep).when(i % 8 == 4, wide).when(i % 8 == 5, F.rtrim(F.col("props"), F.lit("}"))).otherwise(F.col("props"))
    )
    sources = load(spark, sf_dir, "events").select("event_id", text.cast("binary").alias("payload"), F.lit("application/json").alias("mime_type"))
    return parsing.parse_sources(sources, parsing.Limits(json_nodes=70)).select("event_id", "problem")


@query("""SELECT l_orderkey, CASE WHEN l_orderkey % 6 = 1 THEN 'CSV_INVALID' WHEN l_orderkey % 6 = 2 THEN 'CSV_FIELD_LIMIT' WHEN l_orderkey % 6 = 3 THEN CASE WHEN count(*) * 6 > 15 THEN 'CSV_CELL_LIMIT' END
  WHEN count(*) > 4 THEN 'CSV_ROW_LIMIT' END AS problem FROM lineitem GROUP BY l_orderkey""")
def csv_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a CSV source; some orders have an open quote, a long field or many fields."""
    k = F.col("l_orderkey") % 6
    field = F.when(k == 2, F.lpad(F.lit("x"), 40, "x")).otherwise(F.concat(F.lit('"'), "l_returnflag", F.lit(', ""'), "l_linestatus", F.lit('"""')))
    row = F.concat_ws(",", F.col("l_linenumber").cast("string"), field, F.when(k == 3, ",,1").otherwise(F.col("l_partkey").cast("string")), F.when(k == 3, "2"))
    # An order's lines are few.
    orders = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("row")))).alias("rows"))
    text = F.concat(F.when(F.col("l_orderkey") % 6 == 1, F.lit('"open')).otherwise(F.lit("")), F.array_join(F.col("rows.row"), "\r\n"))
    sources = orders.select("l_orderkey", text.cast("binary").alias("payload"), F.lit("text/csv; charset=utf8").alias("mime_type"))
    return parsing.parse_sources(sources, parsing.Limits(csv_rows=4, csv_cells=15, csv_field=30)).select("l_orderkey", "problem")


@query("""SELECT l_orderkey, CASE l_orderkey % 5 WHEN 1 THEN 'XML_INVALID' WHEN 2 THEN 'XML_DOCTYPE' WHEN 3 THEN CASE WHEN l_orderkey % 90 + 1 > 64 THEN 'XML_DEPTH_LIMIT' END
  ELSE CASE WHEN 1 + count(*) > 6 THEN 'XML_NODE_LIMIT' END END AS problem FROM lineitem GROUP BY l_orderkey""")
def xml_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an XML source; some are not closed, have a document type, or are nested."""
    key = F.col("l_orderkey")
    orders = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    deep = F.concat(F.repeat(F.lit("<a>"), (key % 90 + 1).cast("int")), F.repeat(F.lit("</a>"), (key % 90 + 1).cast("int")))
    flat = F.concat(F.lit('<order note="a &gt; b">'), F.repeat(F.lit("<line/>"), F.col("n")), F.lit("</order>"))
    text = F.when(key % 5 == 1, F.lit("<order><line></order>")).when(key % 5 == 2, F.concat(F.lit("<!DOCTYPE order>"), flat)).when(key % 5 == 3, deep).otherwise(flat)
    limits = F.when(key % 5 == 3, "deep").otherwise("flat")
    sources = orders.select("l_orderkey", limits.alias("limits"), text.cast("binary").alias("payload"), F.lit("application/xml").alias("mime_type"))
    nested, rest = sources.filter("limits = 'deep'"), sources.filter("limits = 'flat'")
    return parsing.parse_sources(nested).unionByName(parsing.parse_sources(rest, parsing.Limits(xml_nodes=6))).select("l_orderkey", "problem")


def _conversations(spark: SparkSession, sf_dir: str, row, start: str = "", between: str = "", end: str = "") -> DataFrame:
    """(doc_id, text): each conversation's turns, as ``row`` writes them, one after another (a conversation's turns are few)."""
    c = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", row.alias("row")))).alias("rows")
    )
    return c.select("doc_id", F.concat(F.lit(start), F.array_join(F.col("rows.row"), between), F.lit(end)).alias("text"))


#: A turn as JSON: an object with a list in it.
_JSON_SQL = """format('{{"turn": {}, "role": "{}", "sizes": [{}, {{}}]}}', turn, role, length(text))"""


def _json_turn():
    return F.format_string('{"turn": %d, "role": "%s", "sizes": [%d, {}]}', F.col("turn"), F.col("role"), F.length("text"))


_RECORDS_SQL = f"""r AS (SELECT conv_id AS doc_id, row_number() OVER w - 1 AS i, {_JSON_SQL} AS j, turn, role, length(text) AS n, text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, {_JSON_SQL})),
p AS (SELECT *, 11 + sum(length(j) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(j) - 2 AS s FROM r)"""


@query(f"""WITH {_RECORDS_SQL},
n AS (SELECT doc_id, '/turns/' || i AS pointer, s, s + length(j) AS e, 'object' AS kind FROM p
  UNION ALL SELECT doc_id, '/turns/' || i || '/turn', s + 9, s + 9 + length(turn::VARCHAR), 'number' FROM p
  UNION ALL SELECT doc_id, '/turns/' || i || '/role', s + 19 + length(turn::VARCHAR), s + 21 + length(turn::VARCHAR) + length(role), 'string' FROM p
  UNION ALL SELECT doc_id, '/turns/' || i || '/sizes', s + length(j) - 7 - length(n::VARCHAR), s + length(j) - 1, 'array' FROM p
  UNION ALL SELECT doc_id, '/turns/' || i || '/sizes/0', s + length(j) - 6 - length(n::VARCHAR), s + length(j) - 6, 'number' FROM p
  UNION ALL SELECT doc_id, '/turns/' || i || '/sizes/1', s + length(j) - 4, s + length(j) - 2, 'object' FROM p
  UNION ALL SELECT doc_id, '/turns', 10, max(s + length(j)) + 1, 'array' FROM p GROUP BY doc_id
  UNION ALL SELECT doc_id, '', 0, max(s + length(j)) + 2, 'object' FROM p GROUP BY doc_id)
SELECT doc_id, pointer, s::INT AS char_start, e::INT AS char_end, kind FROM n""")
def json_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of each conversation's JSON, by its pointer and place."""
    return structured.locate_json(_conversations(spark, sf_dir, _json_turn(), '{"turns": [', ", ", "]}"))


@query(f"""WITH {_RECORDS_SQL} SELECT doc_id, '/turns' AS collection, i::INT AS record, s::INT AS char_start, (s + length(j))::INT AS char_end, NULL::VARCHAR AS problem FROM p""")
def json_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each conversation's JSON; the lists inside records are no collections."""
    return structured.record_collections(structured.locate_json(_conversations(spark, sf_dir, _json_turn(), '{"turns": [', ", ", "]}")))


def _packed_sql(places: str, texts: str, most: int, label: str = "") -> str:
    """Chunks to the last place within reach, or cut as ``chunk_boundary``: for (doc_id, text) and (doc_id, list of places)."""
    cut = _CUT_LINES.replace("720", str(most * 6 // 10)).replace("1200", str(most))
    window = most - most * 6 // 10
    return f"""pl AS ({places}), tx AS ({texts}),
r AS (SELECT doc_id, text, list_distinct(list_concat(pl.places, [length(text)])) AS b, 0::BIGINT AS s, 0 AS o, NULL::BIGINT AS e FROM tx JOIN pl USING (doc_id) WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, b, nxt AS s, o + 1, s AS e FROM (
    SELECT *, coalesce(list_max(list_filter(b, lambda x: x > s AND x <= s + {most})), {cut})::BIGINT AS nxt
    FROM (SELECT *, substring(text, s + {most * 6 // 10} + 1, {window}) AS w FROM r WHERE s < length(text)))),
c AS (SELECT doc_id, (o - 1)::INT AS ordinal, e::INT AS char_start, s::INT AS char_end FROM r WHERE e IS NOT NULL)"""


_LONG_SQL = """r0 AS (SELECT conv_id AS doc_id, turn, role, format('{{"turn": {}, "text": "{}"}}', turn, regexp_replace(text, '[^a-z ]', '.', 'g')) AS j FROM conversations),
i0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, role, j) AS i FROM r0),
p0 AS (SELECT *, 1 + sum(length(j) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(j) - 1 AS s FROM i0)"""


@query(f"""WITH RECURSIVE {_LONG_SQL}, {_packed_sql("SELECT doc_id, list(s::BIGINT) || list((s + length(j))::BIGINT) AS places FROM p0 GROUP BY 1",
  "SELECT doc_id, '[' || string_agg(j, ',' ORDER BY i) || ']' AS text FROM p0 GROUP BY 1", 800)} SELECT * FROM c""")
def chunk_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON arrays, cut between records."""
    row = F.format_string('{"turn": %d, "text": "%s"}', F.col("turn"), F.regexp_replace("text", "[^a-z ]", "."))
    return chunking.split_json(_conversations(spark, sf_dir, row, "[", ",", "]"), 800).select("doc_id", "ordinal", "char_start", "char_end")


_XML_SQL = """r0 AS (SELECT conv_id AS doc_id, turn, role, format('<turn role="{}">', role) AS tag, format('<turn role="{}">{}</turn>', role, regexp_replace(text, '[^a-z ]', '.', 'g')) AS j FROM conversations),
i0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, role, j) AS i FROM r0),
p0 AS (SELECT *, 14 + sum(length(j)) OVER (PARTITION BY doc_id ORDER BY i) - length(j) AS s FROM i0)"""


@query(f"""WITH RECURSIVE {_XML_SQL}, {_packed_sql("SELECT doc_id, list(s::BIGINT) || list((s + length(tag))::BIGINT) || list((s + length(j))::BIGINT) || [14::BIGINT] AS places FROM p0 GROUP BY 1",
  "SELECT doc_id, '<conversation>' || string_agg(j, '' ORDER BY i) || '</conversation>' AS text FROM p0 GROUP BY 1", 800)} SELECT * FROM c""")
def chunk_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as XML, cut at tags."""
    row = F.format_string('<turn role="%s">%s</turn>', F.col("role"), F.regexp_replace("text", "[^a-z ]", "."))
    return chunking.split_xml(_conversations(spark, sf_dir, row, "<conversation>", "", "</conversation>"), 800).select("doc_id", "ordinal", "char_start", "char_end")


#: A turn as markdown: a heading of level 1 for the first turns and 2 for the others, fenced code with a false heading, a table, text.
_MD_SQL = """md0 AS (SELECT conv_id AS doc_id, turn, role, (turn % 3 = 0) AS top,
  CASE WHEN turn % 3 = 0 THEN '# ' ELSE '## ' END || role || ' ' || turn || chr(10) AS head, '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) AS fence,
  '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || turn || ' | x |' || chr(10) AS tab,
  regexp_replace(text, '[^a-z ]', '.', 'g') || chr(10) || chr(10) AS body FROM conversations),
md1 AS (SELECT *, head || fence || tab || body AS j, row_number() OVER (PARTITION BY doc_id ORDER BY turn, role, head || fence || tab || body) AS i FROM md0),
md2 AS (SELECT *, sum(length(j)) OVER (PARTITION BY doc_id ORDER BY i) - length(j) AS s, max(CASE WHEN top THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS ti FROM md1),
md AS (SELECT a.doc_id, a.i, a.j, a.s, a.head, a.fence, a.tab, CASE WHEN a.top OR a.ti IS NULL THEN a.role || ' ' || a.turn ELSE t.role || ' ' || t.turn || ' / ' || a.role || ' ' || a.turn END AS label
  FROM md2 a LEFT JOIN md2 t ON t.doc_id = a.doc_id AND t.i = a.ti)"""


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("turn") % 3 == 0, "# ").otherwise("## "), "role", F.lit(" "), F.col("turn").cast("string"))
    row = F.concat(
        name, F.lit("\n```\n# no heading\n```\n| a | b |\n|---|---|\n| "), F.col("turn").cast("string"), F.lit(" | x |\n"),
        F.regexp_replace("text", "[^a-z ]", "."), F.lit("\n\n"),
    )
    return _conversations(spark, sf_dir, row)


@query(f"""WITH RECURSIVE {_MD_SQL}, {_packed_sql("SELECT doc_id * 1000 + i AS doc_id, [length(j)::BIGINT] AS places FROM md",
  "SELECT doc_id * 1000 + i AS doc_id, j AS text FROM md", 800).replace("list_filter(b, lambda x: x > s AND x <= s + 800)", "list_filter(b, lambda x: x > s AND x = length(text) AND x <= s + 800)")}
SELECT md.doc_id, (row_number() OVER (PARTITION BY md.doc_id ORDER BY md.i, c.ordinal) - 1)::INT AS ordinal, (md.s + char_start)::INT AS char_start, (md.s + char_end)::INT AS char_end, label
FROM c JOIN md ON c.doc_id = md.doc_id * 1000 + md.i""")
def chunk_markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as markdown, each section cut on its own and labelled by its path."""
    return chunking.split_markdown_sections(_markdown(spark, sf_dir), 800).select("doc_id", "ordinal", "char_start", "char_end", "label")


@query(f"""WITH RECURSIVE {_MD_SQL}, {_packed_sql('''SELECT doc_id, flatten(list(CASE WHEN length(j) > 800 THEN
    [s, s + length(head), s + length(head) + length(fence), s + length(head) + length(fence) + length(tab), s + length(j)]::BIGINT[] ELSE [s]::BIGINT[] END)) AS places FROM md GROUP BY 1''',
  "SELECT doc_id, string_agg(j, '' ORDER BY i) AS text FROM md GROUP BY 1", 800)},
f AS (SELECT c.*, (SELECT arg_max(label, s) FROM md WHERE md.doc_id = c.doc_id AND s <= char_start) AS a, (SELECT arg_max(label, s) FROM md WHERE md.doc_id = c.doc_id AND s < char_end) AS z FROM c)
SELECT doc_id, ordinal, char_start, char_end, CASE WHEN a = z THEN a ELSE a || ' → ' || z END AS label FROM f""")
def chunk_markdown_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as markdown, short sections packed, long ones cut between their blocks."""
    return chunking.split_markdown_packed(_markdown(spark, sf_dir), 800).select("doc_id", "ordinal", "char_start", "char_end", "label")


@query(f"""WITH RECURSIVE tx0 AS (SELECT conv_id AS doc_id, turn + 1 AS page_number, any_value(text) AS text FROM conversations GROUP BY ALL HAVING length(any_value(text)) > 0 AND count(*) = 1),
{_packed_sql("SELECT doc_id * 1000 + page_number AS doc_id, []::BIGINT[] AS places FROM tx0", "SELECT doc_id * 1000 + page_number AS doc_id, text FROM tx0", 800).replace("list_filter(b, lambda x: x > s AND x <= s + 800)", "list_filter(b, lambda x: x > s AND x = length(text) AND x <= s + 800)")},
pg AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page_number) - length(text) AS place FROM tx0)
SELECT pg.doc_id, (row_number() OVER (PARTITION BY pg.doc_id ORDER BY page_number, ordinal) - 1)::INT AS ordinal, (place + char_start)::INT AS char_start, (place + char_end)::INT AS char_end,
  page_number, 'PDF physical page ' || page_number AS section FROM c JOIN pg ON c.doc_id = pg.doc_id * 1000 + page_number""")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sources whose pages are their turns; chunks stay inside a page."""
    turns = load(spark, sf_dir, "conversations").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id", "turn"))).filter("n = 1")
    pages = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_number"), "text")
    return chunking.split_pages(pages, 800).select("doc_id", "ordinal", "char_start", "char_end", "page_number", "section")


@query("""WITH t AS (SELECT conv_id AS doc_id, turn, role, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, length(text)) AS k, length(text) AS n FROM conversations),
u AS (SELECT *, turn || '.' || k AS name, '## [' || turn || '.' || k || '] ' || role || chr(10) || '| turn | size |' || chr(10) || '|---|:---:|' || chr(10) || '| ' || turn || ' | `a|b` ' || n || '\\| |' || chr(10) AS j FROM t),
p AS (SELECT *, 9 + sum(length(j)) OVER (PARTITION BY doc_id ORDER BY turn, k) - length(j) AS s FROM u),
bad AS (SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN 'MARKDOWN_FENCE_UNCLOSED' WHEN 2 THEN 'MARKDOWN_UNMAPPED_HEADING_LEVEL' WHEN 3 THEN 'MARKDOWN_DUPLICATE_SECTION' WHEN 4 THEN 'MARKDOWN_TABLE_WIDTH' END AS problem
  FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations))
SELECT doc_id, name AS section_id, role AS title, NULL::INT AS "table", NULL::INT AS record, NULL::VARCHAR AS header, NULL::VARCHAR AS value, s::INT AS char_start, (s + length(j))::INT AS char_end, NULL::VARCHAR AS problem
  FROM p JOIN bad USING (doc_id) WHERE problem IS NULL
UNION ALL SELECT doc_id, name, role, 0, 0, 'turn', turn::VARCHAR, (s + length(j) - 17 - length(n::VARCHAR) + 2 - length(turn::VARCHAR) + 1)::INT, (s + length(j) - 17 - length(n::VARCHAR) + 3)::INT, NULL FROM p JOIN bad USING (doc_id) WHERE problem IS NULL
UNION ALL SELECT doc_id, name, role, 0, 0, 'size', '`a|b` ' || n || '\\|', (s + length(j) - 11 - length(n::VARCHAR))::INT, (s + length(j) - 3)::INT, NULL FROM p JOIN bad USING (doc_id) WHERE problem IS NULL
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, problem FROM bad WHERE problem IS NOT NULL""")
def markdown_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sections with a table each; some sources have a fault."""
    by = Window.partitionBy("conv_id", "turn").orderBy("role", F.length("text"))
    turns = load(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(by))
    row = F.format_string("## [%d.%d] %s\n| turn | size |\n|---|:---:|\n| %d | `a|b` %d\\| |\n", "turn", "k", "role", "turn", F.length("text"))
    c = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "k", row.alias("row")))).alias("rows"))
    k = F.col("doc_id") % 9
    end = F.when(k == 1, "```\n").when(k == 2, "### deeper\n").when(k == 3, F.concat(F.lit("## "), F.regexp_extract(F.col("rows.row")[0], r"\[.*?\]", 0), F.lit(" again\n"))).when(
        k == 4, "| 1 | 2 | 3 |\n").otherwise("")
    text = F.concat(F.lit("preamble\n"), F.array_join(F.col("rows.row"), ""), end)
    return structured.locate_markdown(c.select("doc_id", text.alias("text")))


@query("""WITH c AS (SELECT doc_id, unnest(range(0, ((length(text) - 1) // 1200 + 1)::BIGINT)) AS o, length(text) AS n FROM documents WHERE length(text) > 0),
d AS (SELECT doc_id, o, (o + 1) * 1200 < n AS inner_one FROM c WHERE NOT (doc_id % 7 = 3 AND o = 1))
SELECT doc_id, count(*) AS n_chunks, NOT (max(n_chunks_before) > 1 AND doc_id % 7 = 3) AND NOT (doc_id % 7 = 5) AS gapless
FROM d JOIN (SELECT doc_id, count(*) AS n_chunks_before FROM c GROUP BY 1) USING (doc_id) GROUP BY doc_id""")
def gapless_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check on chunks of which some are missing and some have been altered."""
    docs = load(spark, sf_dir, "documents")
    chunks = chunking.split_fixed(docs).filter("NOT (doc_id % 7 = 3 AND ordinal = 1)")
    altered = F.when((F.col("doc_id") % 7 == 5) & (F.col("ordinal") == 0), F.concat("chunk", F.lit("."))).otherwise(F.col("chunk"))
    return chunking.gapless_report(chunks.withColumn("chunk", altered), docs)


@query(f"""WITH t AS (SELECT doc_id, nfc_normalize(text) AS t FROM documents) SELECT doc_id, sha256(t) AS checksum, 'upload-chunking:v1:strategy=fixed:max=900' AS signature,
  ((length(t) - 1) // 900 + 1) AS n_chunks FROM t""")
def parsed_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources read, then cut as an upload's options say."""
    options = chunking.ChunkingOptions(900, "fixed")
    raw = load(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"), F.lit("text/markdown").alias("mime_type"))
    read = parsing.parse_sources(raw).filter("problem IS NULL")
    counts = chunking.split_fixed(read.select("doc_id", "text"), options.max_chars).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return read.select("doc_id", checksum(F.col("text")).alias("checksum"), F.lit(options.signature).alias("signature")).join(counts, "doc_id")


#: A turn as an element: an attribute with an entity, an empty element and one with text.
_TURN_SQL = """t0 AS (SELECT conv_id AS doc_id, turn, role, format('<turn n="{}" who="a &amp; {}"><mark/><size>{}</size></turn>', turn, role, length(text)) AS j, length(text) AS n FROM conversations),
t1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, role, j) AS i FROM t0), t AS (SELECT *, 7 + sum(length(j)) OVER (PARTITION BY doc_id ORDER BY i) - length(j) AS s FROM t1)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.format_string('<turn n="%d" who="a &amp; %s"><mark/><size>%d</size></turn>', F.col("turn"), F.col("role"), F.length("text"))
    return structured.locate_xml(_conversations(spark, sf_dir, row, "<talks>", "", "</talks>"))


@query(f"""WITH {_TURN_SQL}
SELECT doc_id, '/talks/turn[' || i || ']' AS path, 'element' AS kind, s::INT AS char_start, (s + length(j))::INT AS char_end, NULL AS value FROM t
UNION ALL SELECT doc_id, '/talks/turn[' || i || ']/@n', 'attribute', (s + 9)::INT, (s + 9 + length(turn::VARCHAR))::INT, turn::VARCHAR FROM t
UNION ALL SELECT doc_id, '/talks/turn[' || i || ']/@who', 'attribute', (s + 16 + length(turn::VARCHAR))::INT, (s + 24 + length(turn::VARCHAR) + length(role))::INT, 'a & ' || role FROM t
UNION ALL SELECT doc_id, '/talks/turn[' || i || ']/mark[1]', 'element', (s + length(j) - 27 - length(n::VARCHAR))::INT, (s + length(j) - 20 - length(n::VARCHAR))::INT, '' FROM t
UNION ALL SELECT doc_id, '/talks/turn[' || i || ']/size[1]', 'element', (s + length(j) - 20 - length(n::VARCHAR))::INT, (s + length(j) - 7)::INT, n::VARCHAR FROM t
UNION ALL SELECT doc_id, '/talks', 'element', 0, (max(s + length(j)) + 8)::INT, NULL FROM t GROUP BY doc_id""")
def xml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element and attribute of each conversation's XML, by its path and place."""
    return _turns(spark, sf_dir)


@query(f"""WITH {_TURN_SQL} SELECT doc_id, '/talks/turn[' || i || ']' AS record, f.name, CASE f.name WHEN 'Speaker' THEN 'a & ' || role WHEN 'Length' THEN n::VARCHAR END AS value,
  CASE f.name WHEN 'Speaker' THEN (s + 16 + length(turn::VARCHAR))::INT WHEN 'Length' THEN (s + length(j) - 20 - length(n::VARCHAR))::INT END AS char_start,
  CASE f.name WHEN 'Speaker' THEN (s + 24 + length(turn::VARCHAR) + length(role))::INT WHEN 'Length' THEN (s + length(j) - 7)::INT END AS char_end FROM t, (VALUES ('Speaker'), ('Length'), ('Mood')) f(name)""")
def mapped_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' XML elements by a table of fields; no turn has a mood."""
    return structured.map_elements(_turns(spark, sf_dir), "/talks/turn", {"Speaker": "@who", "Length": "size", "Mood": "@mood"})
