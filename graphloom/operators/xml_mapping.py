"""Configured mapping of located XML: a small path language, records with scoped identities, typed properties, relations, coverage.

Selectors become conditions on the paths of located nodes (``structured.locate_xml``), so a mapping is a handful of joins over all sources at once,
however many records they have. Selectors: names, ``/``, ``//``, ``[@a='v']``, and last ``@name``, ``@*`` or ``text()``; none begins with ``//``.

A mapping: collections [id, select, type, identity, properties, retained], relationships [type, kind, from, to, select, target_select], deferred
[type, collection], retained [selectors]. ``type`` is a name or cases [when {selector: value}, entity_type]; identity has fields, and may have
scope (selectors too) and owner (an earlier collection, whose nearest record above gives its identity). Properties are [select, property] with a
transform: copy, enum (values) or quantity (unit). A reference relation joins the value of ``select`` at its source with that of
``target_select`` at its target; a parent relation takes the nearest record above.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.staging import stage

_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*"
_STEP = re.compile(rf"({_NAME})(?:\[@({_NAME})='([^'/]*)'\])?")
#: A quantity is a number and its unit, with or without a blank between.
QUANTITY = r"^([+-]?(?:0|[1-9]\d*)(?:\.\d+)?)\s*(\D\S*)$"
_INDEX = r"(?:\[\d+\])?"


@dataclass(frozen=True)
class Selector:
    """A compiled selector: a pattern of the path below its base, and the attributes that steps must have (group of the step, name, value)."""

    absolute: bool
    pattern: str
    predicates: tuple
    scalar: bool
    attribute: bool


def compile_selector(text: str) -> Selector:
    """ValueError for what the language has not."""
    if not isinstance(text, str) or not 0 < len(text) <= 2048 or text.startswith("//") or text.endswith("/") or "///" in text:
        raise ValueError(f"unsupported selector {text!r}")
    absolute = text.startswith("/")
    pieces = re.split(r"(/+)", text.lstrip("/"))
    pattern, predicates, scalar, attribute = "", [], False, False
    for k in range(0, len(pieces), 2):
        step, axis, last = pieces[k], pieces[k - 1] if k else "/", k == len(pieces) - 1
        if step.startswith("@") or step == "text()":
            if not last or axis != "/" or (step.startswith("@") and step != "@*" and not re.fullmatch(_NAME, step[1:])):
                raise ValueError(f"unsupported selector {text!r}")
            scalar, attribute = True, step.startswith("@")
            if step == "text()":
                continue
            pattern += ("/" if pattern else "") + ("@[^/]+" if step == "@*" else re.escape(step))
            continue
        m = _STEP.fullmatch(step)
        if not m or axis not in ("/", "//"):
            raise ValueError(f"unsupported selector {text!r}")
        name, having, value = m.groups()
        pattern += ("/" if pattern else "") + (r"(?:[^/@]+/)*?" if axis == "//" else "") + re.escape(name) + _INDEX
        if having:
            pattern = f"({pattern})"
            predicates = [(g + 1, a, v) for g, a, v in predicates] + [(1, having, value)]
    return Selector(absolute, pattern, tuple(predicates), scalar, attribute)


def _above(path: Column) -> Column:
    """The paths of the elements above a node, the nearest last."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, 1, k), "/"))


def select(nodes: DataFrame, selector: str, base: DataFrame | None = None) -> DataFrame:
    """(id, node, path, value, char_start, char_end): what a selector finds below each base (id, node), or in each source if it is absolute.

    ``nodes`` is (id, path, kind, value, char_start, char_end). A path is found once for a base. text() finds elements with a text.
    """
    s = compile_selector(selector)
    kind = F.col("kind") == ("attribute" if s.attribute else "element")
    found = nodes.filter(kind & F.col("path").rlike(f"(?:^|/){s.pattern}$") if s.pattern else kind)
    if s.scalar and not s.attribute:
        found = found.filter(F.length(F.trim("value")) > 0)
    if s.absolute:
        if base is not None:
            raise ValueError("an absolute selector has no base")
        found = found.withColumn("node", F.lit("")).withColumn("below", F.substr("path", F.lit(2), F.length("path")))
    else:
        if base is None:
            raise ValueError("a relative selector needs a base")
        itself = s.pattern == ""  # text() of the base
        at = F.array(F.col("path")) if itself else _above(F.col("path"))
        found = found.withColumn("node", F.explode(at)).join(base.select("id", "node").distinct(), ["id", "node"], "left_semi")
        found = found.withColumn("below", F.substr("path", F.length("node") + 2, F.length("path")))
    found = found.filter(F.col("below").rlike(f"^{s.pattern}$"))
    for group, name, value in s.predicates:
        owner = F.regexp_extract("below", f"^{s.pattern}$", group)
        wanted = nodes.filter((F.col("kind") == "attribute") & (F.col("value") == value) & F.col("path").endswith(f"/@{name}")).select("id", F.col("path").alias("at"))
        found = found.withColumn("at", F.concat("node", F.lit("/"), owner, F.lit(f"/@{name}"))).join(wanted, ["id", "at"], "left_semi").drop("at")
    return found.select("id", "node", "path", "value", "char_start", "char_end").distinct()


def _scalar(nodes: DataFrame, selector: str, base: DataFrame, name: str) -> DataFrame:
    """(id, node, ``name`` (value), n, at): the one value that a selector finds at each base; n tells how many there were."""
    if not compile_selector(selector).scalar:
        raise ValueError(f"{selector!r} selects elements, not values")
    return select(nodes, selector, base).groupBy("id", "node").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias(name), F.min("path").alias("at"))


def _nearest(records: DataFrame, owners: DataFrame) -> DataFrame:
    """(id, path, owner, owner_path): the nearest owner (id, path, identity) above each record (id, path)."""
    up = records.select("id", "path", F.explode(_above(F.col("path"))).alias("up"))
    held = up.join(owners.select("id", F.col("path").alias("up"), "identity", F.col("entity_type").alias("kind")), ["id", "up"])
    last = F.max_by(F.struct("up", "identity", "kind"), F.length("up"))
    return held.groupBy("id", "path").agg(last.alias("o")).select("id", "path", F.col("o.identity").alias("owner"), F.col("o.up").alias("owner_path"), F.col("o.kind").alias("owner_type"))


def map_xml(nodes: DataFrame, mapping: dict, types: dict[str, dict[str, bool]], relations: dict[str, list[tuple[str, str]]]) -> dict[str, DataFrame]:
    """entities, properties, relationships, diagnostics and coverage of all sources under a mapping.

    ``types``: of each entity type its properties, and whether they are required; ``relations``: of each relation the types of its ends.
    entities (id, collection, path, entity_type, identity), properties (id, identity, property, value, unit, path), relationships (id, type, source,
    target, basis), diagnostics (id, code, path), coverage (id, path, disposition): every attribute and text is mapped, binding (it decides
    identity, type or a reference), retained or unmapped. An identity that two records of a collection have is neither's. A source with a
    fault has the one diagnostic that says so. References that no or several targets have are diagnosed, never guessed.
    """
    whole = stage(nodes.toDF("id", *nodes.columns[1:]), "xml-nodes")
    n = whole.filter("kind <> 'error'")
    entities: dict[str, DataFrame] = {}
    properties, relationships, said, marks = [], [], [whole.filter("kind = 'error'").select("id", F.lit("XML_SOURCE_INVALID").alias("code"), F.lit("").alias("path"))], []

    def diagnose(rows: DataFrame, code: str | Column, path: str = "path") -> None:
        said.append(rows.select("id", (F.lit(code) if isinstance(code, str) else code).alias("code"), F.col(path).alias("path")))

    def mark(rows: DataFrame, disposition: str, path: str = "path") -> None:
        marks.append(rows.select("id", F.col(path).alias("path"), F.lit(disposition).alias("disposition")))

    def retain(rows: DataFrame) -> None:
        mark(rows, "retained")

    for selector in mapping.get("retained", ()):
        retain(select(n, selector))
    for rule in mapping["collections"]:
        name, identity = rule["id"], rule["identity"]
        if name in entities:
            raise ValueError(f"two collections {name!r}")
        chosen = stage(reduce(DataFrame.unionByName, (select(n, s) for s in rule["select"])).select("id", F.col("path").alias("node")).distinct(), "xml-records")
        for selector in rule.get("retained", ()):
            retain(select(n, selector, chosen))
        records = chosen
        if isinstance(rule["type"], str):
            records = records.withColumn("entity_type", F.lit(rule["type"]))
        else:
            fits = []
            for k, case in enumerate(rule["type"]):
                met = chosen
                for selector, expected in case["when"].items():
                    value = _scalar(n, selector, chosen, "v")
                    mark(value, "binding", "at")
                    met = met.join(value.filter((F.col("n") == 1) & (F.col("v") == expected)), ["id", "node"], "left_semi")
                fits.append(met.select("id", "node", F.lit(k).alias("case"), F.lit(case["entity_type"]).alias("entity_type")))
            of = reduce(DataFrame.unionByName, fits).groupBy("id", "node").agg(F.count(F.lit(1)).alias("cases"), F.min("entity_type").alias("entity_type"))
            typed = chosen.join(of, ["id", "node"], "left")
            diagnose(typed.filter("cases IS NULL"), "XML_TYPE_UNMAPPED", "node")
            diagnose(typed.filter("cases > 1"), "XML_TYPE_AMBIGUOUS", "node")
            records = typed.filter("cases = 1").select("id", "node", "entity_type")
        known = F.col("entity_type").isin(*types)
        diagnose(records.filter(~known), "XML_TYPE_UNDECLARED", "node")
        records, parts = records.filter(known), []
        if identity.get("owner"):
            owned = _nearest(records.select("id", F.col("node").alias("path")), entities[identity["owner"]])
            records = records.join(owned.select("id", F.col("path").alias("node"), "owner"), ["id", "node"], "left")
            diagnose(records.filter("owner IS NULL"), "XML_IDENTITY_OWNER_MISSING", "node")
            records, parts = records.filter("owner IS NOT NULL"), ["owner"]
        for k, selector in enumerate([*identity.get("scope", ()), *identity["fields"]]):
            value = _scalar(n, selector, records, f"part{k}")
            mark(value, "binding", "at")
            records = records.join(value.drop("at"), ["id", "node"], "left")
            usable = (F.col("n") == 1) & (F.length(F.trim(f"part{k}")) > 0) & (F.length(f"part{k}") <= 512)
            diagnose(records.filter(~F.coalesce(usable, F.lit(False))), "XML_IDENTITY_INVALID", "node")
            records = records.filter(usable).drop("n")
            parts.append(f"part{k}")
        digest = F.sha2(F.to_json(F.struct(F.lit(name).alias("collection"), F.array(*parts).alias("parts"))).cast("binary"), 256)
        records = stage(records.select("id", F.col("node").alias("path"), "entity_type", F.concat(F.lit("xml:"), digest).alias("identity")), "xml-identities")
        alone = records.groupBy("id", "identity").agg(F.count(F.lit(1)).alias("n"))
        twice = alone.filter("n > 1").select("id", "identity")
        diagnose(records.join(twice, ["id", "identity"], "left_semi"), "XML_IDENTITY_DUPLICATE")
        own = stage(records.join(twice, ["id", "identity"], "left_anti").withColumn("collection", F.lit(name)), "xml-entities")
        entities[name] = own
        base, made = own.select("id", F.col("path").alias("node")), []
        for p in rule.get("properties", ()):
            value = _scalar(n, p["select"], base, "v")
            diagnose(value.filter("n > 1"), "XML_VALUE_AMBIGUOUS", "node")
            value = value.filter("n = 1 AND v <> ''").join(own.select("id", F.col("path").alias("node"), "identity", "entity_type"), ["id", "node"])
            declared = F.lit(False)
            for kind, names in types.items():
                if p["property"] in names:
                    declared |= F.col("entity_type") == kind
            diagnose(value.filter(~declared), "XML_PROPERTY_UNDECLARED", "at")
            value, transform = value.filter(declared), p.get("transform", "copy")
            given, unit, code = F.col("v"), F.lit(None).cast("string"), None
            if transform == "enum":
                given = F.create_map(*[F.lit(x) for pair in p["values"].items() for x in pair])[F.col("v")]
                code = "XML_ENUM_UNMAPPED"
            elif transform == "quantity":
                fits_unit = F.regexp_extract("v", QUANTITY, 2) == p["unit"]
                given, unit, code = F.when(fits_unit, F.regexp_extract("v", QUANTITY, 1)), F.lit(p["unit"]), "XML_QUANTITY_INVALID"
            elif transform != "copy":
                raise ValueError(f"no transform {transform!r}")
            value = value.withColumn("value", given)
            if code:
                diagnose(value.filter("value IS NULL"), code, "at")
            value = value.filter("value IS NOT NULL")
            mark(value, "mapped", "at")
            made.append(value.select("id", "identity", F.lit(p["property"]).alias("property"), "value", unit.alias("unit"), F.col("at").alias("path"), "node"))
        if made:
            mine = stage(reduce(DataFrame.unionByName, made), "xml-properties")
            again = mine.groupBy("id", "node", "property").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            diagnose(again.select("id", "node").distinct(), "XML_PROPERTY_DUPLICATE", "node")
            properties.append(mine.drop("node"))
        for kind, names in types.items():
            for needed in (p for p, required in names.items() if required):
                of_kind = own.filter(F.col("entity_type") == kind)
                have = mine.filter(F.col("property") == needed).select("id", "identity") if made else own.limit(0).select("id", "identity")
                diagnose(of_kind.join(have, ["id", "identity"], "left_anti"), "XML_REQUIRED_PROPERTY_MISSING")
    for rule in mapping.get("relationships", ()):
        source, target, ends = entities[rule["from"]], entities[rule["to"]], relations[rule["type"]]
        if rule["kind"] == "parent":
            near = _nearest(target.select("id", "path"), source)
            pairs = near.join(target, ["id", "path"]).select(
                "id", F.col("owner").alias("source"), F.col("owner_type").alias("s_type"), F.col("owner_path").alias("at"), F.col("identity").alias("target"), F.col("entity_type").alias("t_type"))
        elif rule["kind"] == "reference":
            bases = [e.select("id", F.col("path").alias("node")) for e in (source, target)]
            wanted, keys = _scalar(n, rule["select"], bases[0], "v"), _scalar(n, rule["target_select"], bases[1], "v")
            mark(wanted, "binding", "at")
            mark(keys, "binding", "at")
            held = keys.filter("n = 1").join(target.select("id", F.col("path").alias("node"), "identity", "entity_type"), ["id", "node"])
            held = held.groupBy("id", F.col("v").alias("key")).agg(F.count(F.lit(1)).alias("targets"), F.min("identity").alias("target"), F.min("entity_type").alias("t_type"))
            asked = wanted.filter("n = 1 AND v <> ''").join(source.select("id", F.col("path").alias("node"), F.col("identity").alias("source"), F.col("entity_type").alias("s_type")), ["id", "node"])
            met = asked.join(held.withColumnRenamed("id", "h_id"), (F.col("id") == F.col("h_id")) & (F.col("v") == F.col("key")), "left")
            diagnose(met.filter("targets IS NULL"), "XML_REFERENCE_UNRESOLVED", "at")
            diagnose(met.filter("targets > 1"), "XML_REFERENCE_AMBIGUOUS", "at")
            pairs = met.filter("targets = 1").select("id", "source", "s_type", "at", "target", "t_type")
        else:
            raise ValueError(f"no relation by {rule['kind']!r}")
        allowed = F.lit(False)
        for a, b in ends:
            allowed |= (F.col("s_type") == a) & (F.col("t_type") == b)
        pairs = stage(pairs.withColumn("allowed", allowed), "xml-pairs")
        diagnose(pairs.filter("NOT allowed"), "XML_RELATIONSHIP_ENDPOINT_INVALID", "at")
        relationships.append(pairs.filter("allowed").select("id", F.lit(rule["type"]).alias("type"), "source", "target", F.lit(rule["kind"]).alias("basis")))
    for deferred in mapping.get("deferred", ()):
        diagnose(entities[deferred["collection"]].select("id").distinct().withColumn("path", F.lit(deferred["collection"])), "XML_SEMANTIC_BINDING_DEFERRED")
    fields = n.filter("kind = 'attribute' OR length(trim(value)) > 0").select("id", "path")
    weight = F.max(F.when(F.col("disposition") == "mapped", 3).when(F.col("disposition") == "binding", 2).otherwise(1)).alias("weight")
    held = reduce(DataFrame.unionByName, marks).groupBy("id", "path").agg(weight)
    disposition = F.when(F.col("weight") == 3, "mapped").when(F.col("weight") == 2, "binding").when(F.col("weight") == 1, "retained").otherwise("unmapped")
    coverage = fields.join(held, ["id", "path"], "left").select("id", "path", disposition.alias("disposition"))
    empty = whole.limit(0)
    cast = lambda *names: empty.select("id", *[F.lit(None).cast("string").alias(c) for c in names])
    joined = reduce(DataFrame.unionByName, relationships) if relationships else cast("type", "source", "target", "basis")
    counted = joined.groupBy("id", "type", "source", "target").agg(F.count(F.lit(1)).alias("n"), F.min("basis").alias("basis"))
    diagnose(counted.filter("n > 1"), "XML_RELATIONSHIP_DUPLICATE", "source")
    return {
        "entities": reduce(DataFrame.unionByName, entities.values()).select("id", "collection", "path", "entity_type", "identity"),
        "properties": reduce(DataFrame.unionByName, properties) if properties else cast("identity", "property", "value", "unit", "path"),
        "relationships": counted.drop("n"), "diagnostics": reduce(DataFrame.unionByName, said), "coverage": coverage,
    }
