"""Views of a published graph: trust, inventory, previews, graph pages, configured mappings, and windows into sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What each trust policy admits, and how many nodes and edges a graph page may hold.
TRUST = {"AUTHORITATIVE_ONLY": ("AUTHORITATIVE",), "AUTHORITATIVE_AND_SECONDARY": ("AUTHORITATIVE", "SECONDARY")}
PAGE_NODES, PAGE_EDGES = 200, 300


def trusted(rows: DataFrame, policy: str, column: str = "authority") -> DataFrame:
    return rows.filter(F.col(column).isin(*TRUST[policy]))


def entity_views(entities: DataFrame, mentions: DataFrame, facts: DataFrame, most_evidence: int = 3) -> DataFrame:
    """One row for each entity: (entity_id, aliases, layers, evidence, n_mentions, properties).

    entities (entity_id, aliases); mentions (entity_id, chunk_id, layer, alias); facts (entity_id, name, value). Names and layers are
    sets, evidence its first chunks; a property with several values keeps them all, in order.
    """
    nth = F.row_number().over(Window.partitionBy("entity_id").orderBy("chunk_id"))
    # Chunks are counted and cut before they are listed, so an entity that a third of all chunks mention makes no long list.
    chunks = mentions.groupBy("entity_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")).withColumn("nth", nth)
    seen = chunks.groupBy(F.col("entity_id").alias("m_id")).agg(
        F.sum("n").alias("n_mentions"), F.array_sort(F.collect_list(F.when(F.col("nth") <= most_evidence, F.col("chunk_id")))).alias("evidence")
    )
    names = mentions.select("entity_id", "alias", "layer").distinct().groupBy(F.col("entity_id").alias("n_id")).agg(
        F.collect_set("alias").alias("said"), F.array_sort(F.collect_set("layer")).alias("layers")
    )
    values = facts.distinct().groupBy("entity_id", "name").agg(F.array_sort(F.collect_set("value")).alias("values"))
    properties = values.groupBy(F.col("entity_id").alias("p_id")).agg(F.array_sort(F.collect_list(F.concat(F.col("name"), F.lit("="), F.array_join("values", "|")))).alias("properties"))
    none = F.array().cast("array<string>")
    joined = entities.join(seen, F.col("entity_id") == F.col("m_id"), "left").join(names, F.col("entity_id") == F.col("n_id"), "left").join(properties, F.col("entity_id") == F.col("p_id"), "left")
    return joined.select(
        "entity_id", F.array_sort(F.array_distinct(F.concat("aliases", F.coalesce("said", none)))).alias("aliases"), F.coalesce("layers", none).alias("layers"),
        F.coalesce("evidence", F.array().cast("array<long>")).alias("evidence"), F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"), F.coalesce("properties", none).alias("properties"),
    )


def graph_page(edges: DataFrame, literals: DataFrame, nodes: DataFrame, depths: DataFrame, size: int) -> DataFrame:
    """(place, kind, key, depth, has_more) of the first ``size`` entries: by depth, then relationships, properties and nodes.

    edges (key, source, target), literals (key, node), nodes (node) and depths (node, depth). An entry lies as deep as the nearer of
    its ends. A page also ends before the entry that would give it too many nodes or edges.
    """
    at = depths.select(F.col("node").alias("d_node"), "depth")
    ends = edges.select("key", F.explode(F.array("source", "target")).alias("node"))
    near = ends.join(at, F.col("node") == F.col("d_node")).groupBy("key").agg(F.min("depth").alias("depth"))
    of_edges = near.join(edges, "key").select(F.lit("relationship").alias("kind"), "key", "depth", F.array("source", "target").alias("ends"))
    of_literals = literals.join(at, F.col("node") == F.col("d_node")).select(F.lit("property").alias("kind"), "key", "depth", F.array("node").alias("ends"))
    of_nodes = nodes.join(at, F.col("node") == F.col("d_node")).select(F.lit("node").alias("kind"), F.col("node").alias("key"), "depth", F.array("node").alias("ends"))
    rank = F.when(F.col("kind") == "relationship", 0).when(F.col("kind") == "property", 1).otherwise(2)
    order = [F.col("depth"), F.col("rank"), F.col("key")]
    # One entry more than the page tells whether there is more; what follows sorts a page, not the graph.
    first = of_edges.unionByName(of_literals).unionByName(of_nodes).withColumn("rank", rank).orderBy(*order).limit(size + 1)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    so_far = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.size(F.array_distinct(F.flatten(F.collect_list("ends").over(so_far))))
    counted = placed.withColumn("fits", (F.col("place") <= size) & (seen <= PAGE_NODES) & (F.count_if(F.col("kind") == "relationship").over(so_far) <= PAGE_EDGES))
    whole = counted.withColumn("cut", F.min(F.when(~F.col("fits"), F.col("place"))).over(Window.partitionBy(F.lit(0))))
    return whole.filter(F.coalesce(F.col("place") < F.col("cut"), F.lit(True))).select("place", "kind", "key", "depth", F.col("cut").isNotNull().alias("has_more"))


def in_request_order(rows: DataFrame, ids: list, key: str) -> DataFrame:
    """(position, key, others): the rows of the wanted ids in the order of the request; ids that are not there give no row."""
    asked = rows.sparkSession.createDataFrame([(list(ids),)], f"ids array<{dict(rows.dtypes)[key]}>").select(F.posexplode("ids").alias("position", key))
    return asked.join(rows, key)


def probed(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows with ``overflow``: whether one more was there."""
    first = rows.orderBy(*order).limit(most + 1).withColumn("nth", F.row_number().over(Window.orderBy(*order)))
    return first.withColumn("overflow", F.max("nth").over(Window.partitionBy(F.lit(0))) > most).filter(F.col("nth") <= most).drop("nth")


def nearest_ancestors(paths: DataFrame, mapped: DataFrame) -> DataFrame:
    """(id, path, ancestor): the longest proper prefix, by "/" steps, of each path that is mapped; null if none is. Both have (id, path)."""
    steps = F.split("path", "/")
    above = paths.select("id", "path", F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("up"))
    known = above.filter(F.col("up") != F.col("path")).join(mapped.select("id", F.col("path").alias("up")).distinct(), ["id", "up"])
    best = known.groupBy("id", "path").agg(F.max_by("up", F.length("up")).alias("ancestor"))
    return paths.join(best, ["id", "path"], "left").select("id", "path", "ancestor")


@dataclass(frozen=True)
class Field:
    """A property of a mapped record: where it stands in the record, and its name."""

    pointer: str
    name: str


def map_records(nodes: DataFrame, texts: DataFrame, collection: str, fields: list[Field], key: str = "doc_id") -> DataFrame:
    """(key, record, record_start, record_end, name, value, value_start, value_end): each field of each record of a collection, with its evidence.

    ``nodes`` as ``structured.locate_json`` gives them; a field that a record lacks gives a row without a value. The mapping is a
    table of fields, so a source is read once however many fields it has.
    """
    table = nodes.sparkSession.createDataFrame([(f.pointer, f.name) for f in fields], "field string, name string")
    record = F.regexp_extract("pointer", f"^{collection}/([0-9]+)$", 1)
    records = nodes.filter(record != "").select(key, record.cast("int").alias("record"), F.col("char_start").alias("record_start"), F.col("char_end").alias("record_end"))
    inside = nodes.select(
        F.col(key).alias("v_key"), F.regexp_extract("pointer", f"^{collection}/([0-9]+)(/.*)$", 1).alias("v_record"),
        F.regexp_extract("pointer", f"^{collection}/([0-9]+)(/.*)$", 2).alias("v_field"), F.col("char_start").alias("value_start"), F.col("char_end").alias("value_end"),
    ).filter("v_record <> ''")
    wanted = records.crossJoin(F.broadcast(table))  # a mapping's fields are few
    found = wanted.join(inside, (F.col(key) == F.col("v_key")) & (F.col("record") == F.col("v_record").cast("int")) & (F.col("field") == F.col("v_field")), "left")
    value = F.substring(F.col("text"), F.col("value_start") + 1, F.col("value_end") - F.col("value_start"))
    return found.join(texts.select(F.col(key).alias("t_key"), "text"), F.col(key) == F.col("t_key")).select(
        key, "record", "record_start", "record_end", "name", value.alias("value"), "value_start", "value_end"
    )


def _hits(text: Column, terms: list[str]) -> Column:
    """Where (from 1) each term first stands in the text as a word, 0 for nowhere."""

    def pattern(term: str) -> str:
        quoted = "".join(c if c.isalnum() else "\\" + c for c in term)
        return "(?iu)" + (rf"(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])" if term.isascii() else quoted)

    return F.array(*[F.regexp_instr(text, F.lit(pattern(t))) for t in terms])


def _start(size: Column, hits: Column, terms: list[str], width: Column) -> Column:
    anchor = F.lit(0)
    for k, term in reversed(list(enumerate(terms))):
        around = F.greatest(F.lit(0), hits[k] - 1 - F.floor((width - len(term)) / 2).cast("int"))
        anchor = F.when((hits[k] > 0) & (F.lit(len(term)) <= width), around).otherwise(anchor)
    return F.least(anchor, F.greatest(size - width, F.lit(0)))


def window_start(text: Column, terms: list[str], width: Column) -> Column:
    """Where (from 0) a window of ``width`` characters lies: around the first term that occurs as a word, or at the head."""
    return _start(F.length(text), _hits(text, terms), terms, width)


def byte_bounded_window(text: Column, terms: list[str], most_bytes: int) -> Column:
    """The widest window around the first term whose UTF-8 is at most ``most_bytes``, found by halving; a short text is its own window."""
    one = F.lit(1)

    def widest(found: Column) -> Column:
        """``found`` (hits, size), searched once for all widths."""

        def step(s: Column, _: Column) -> Column:
            width = F.floor((s["low"] + s["high"]) / 2).cast("int")
            fine = F.octet_length(F.substring(text, _start(found["size"], found["hits"], terms, width) + 1, width)) <= most_bytes
            halved = F.when(fine, F.struct((width + 1).alias("low"), s["high"].alias("high"), width.alias("width"))).otherwise(
                F.struct(s["low"].alias("low"), (width - 1).alias("high"), s["width"].alias("width"))
            )
            return F.when(s["low"] > s["high"], s).otherwise(halved)

        start = F.struct(one.alias("low"), F.least(found["size"] - 1, F.lit(most_bytes)).alias("high"), one.alias("width"))
        width = F.aggregate(F.sequence(F.lit(1), F.lit(most_bytes.bit_length() + 1)), start, step, lambda s: s["width"])
        return F.struct(_start(found["size"], found["hits"], terms, width).alias("start"), width.alias("width"))

    places = F.transform(F.array(F.struct(_hits(text, terms).alias("hits"), F.length(text).alias("size"))), widest)
    cut = F.transform(places, lambda p: F.substring(text, p["start"] + 1, p["width"]))
    return F.when(F.octet_length(text) <= most_bytes, text).otherwise(cut[0])
