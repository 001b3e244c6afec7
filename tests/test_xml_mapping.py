"""Selectors against a walk over Python's own tree, and what a mapping does with faults."""

from __future__ import annotations

import hashlib
import json
import random
import xml.etree.ElementTree as ET

import pytest

from graphloom.operators import xml_mapping
from graphloom.sources import structured


def random_xml(rng: random.Random, depth: int = 0) -> str:
    name = rng.choice(["a", "b", "c"]) if depth else "a"
    attributes = "".join(f' {k}="{rng.choice("xyz")}"' for k in ("p", "q") if rng.random() < 0.5)
    if depth == 4 or (depth and rng.random() < 0.3):
        return f"<{name}{attributes}>{rng.choice(['', ' ', 'text', '&lt;x', 'é'])}</{name}>"
    return f"<{name}{attributes}>" + "".join(random_xml(rng, depth + 1) for _ in range(rng.randint(1, 3))) + f"</{name}>"


def walk(root: ET.Element) -> dict[str, ET.Element]:
    out = {f"/{root.tag}": root}
    open_ = [(f"/{root.tag}", root)]
    while open_:
        path, element = open_.pop()
        counts: dict[str, int] = {}
        for child in element:
            counts[child.tag] = counts.get(child.tag, 0) + 1
            at = f"{path}/{child.tag}[{counts[child.tag]}]"
            out[at] = child
            open_.append((at, child))
    return out


def by_hand(tree: dict[str, ET.Element], base: str | None, selector: str) -> set[str]:
    """Step by step, over the elements of the tree."""
    steps = selector.replace("//", "/~").lstrip("/").split("/")
    current = {base} if base is not None else None
    for k, step in enumerate(steps):
        deep, step = step.startswith("~"), step.removeprefix("~")
        if step == "text()":
            return {p for p in current if len(tree[p]) == 0 and (tree[p].text or "").strip(" ")}
        if step.startswith("@"):
            return {f"{p}/@{n}" for p in current for n in tree[p].attrib if step in ("@*", f"@{n}")}
        name, _, rest = step.partition("[")
        if current is None:
            found = {p for p in tree if p.count("/") == 1}
        else:
            found = {p for p in tree if any(p.startswith(c + "/") and (deep or p.count("/") == c.count("/") + 1) for c in current)}
        found = {p for p in found if tree[p].tag == name}
        if rest:
            attribute, value = rest[1:-1].split("=")
            found = {p for p in found if tree[p].attrib.get(attribute) == value.strip("'")}
        current = found
    return current


SELECTORS = ["a", "b", "a/b", "a//b", "b//c/@p", "@p", "@*", "text()", "b/text()", "a//c/text()", "b[@p='x']", "b[@p='x']/@q", "a//b[@q='y']/c", "a[@p='x']//b[@p='z']/@*", "c[@p='x']/text()", "a//b//c"]
ABSOLUTE = ["/a", "/a/b", "/a//c", "/a/@p", "/a//b[@p='x']/@q", "/a[@q='z']//c", "/b", "/a//b/text()"]


def test_selectors_find_what_a_walk_finds(spark):
    rng = random.Random(11)
    texts = {k: random_xml(rng) for k in range(40)}
    trees = {k: walk(ET.fromstring(t)) for k, t in texts.items()}
    nodes = spark.createDataFrame(
        structured.locate_xml(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(),
        "id long, path string, kind string, char_start int, char_end int, value string")
    every = spark.createDataFrame([(k, p) for k, tree in trees.items() for p in tree], "id long, node string")
    for selector in SELECTORS:
        got = {(r.id, r.node, r.path) for r in xml_mapping.select(nodes, selector, every).collect()}
        want = {(k, base, p) for k, tree in trees.items() for base in tree for p in by_hand(tree, base, selector)}
        assert got == want, selector
    for selector in ABSOLUTE:
        got = {(r.id, r.path) for r in xml_mapping.select(nodes, selector).collect()}
        assert got == {(k, p) for k, tree in trees.items() for p in by_hand(tree, None, selector)}, selector


@pytest.mark.parametrize("wrong", ["", "//a", "a/", "a///b", "a/@b/c", "*", "a[1]", "a[@b]", "..", "a/..", "@1", "text()/a", "a[@b='x'", "a b", "x" * 3000, None, 3])
def test_other_selectors_are_refused(wrong):
    with pytest.raises(ValueError, match="selector"):
        xml_mapping.compile_selector(wrong)


MAPPING = {
    "collections": [
        {"id": "site", "select": ["/r//site"], "type": "Site", "identity": {"fields": ["@k"]}, "properties": [{"select": "@name", "property": "Name"}]},
        {"id": "part", "select": ["/r//part", "/r/site/part"], "type": [{"when": {"@t": "m"}, "entity_type": "Motor"}, {"when": {"@t": "m", "@x": "1"}, "entity_type": "Motor"}, {"when": {"@t": "u"}, "entity_type": "Unknown"}],
         "identity": {"owner": "site", "scope": ["@s"], "fields": ["@k"]}, "properties": [{"select": "@w", "property": "Weight", "transform": "quantity", "unit": "kg"}, {"select": "w/text()", "property": "Weight"}, {"select": "@o", "property": "Other"}]},
    ],
    "relationships": [{"type": "NEXT", "kind": "reference", "from": "part", "to": "part", "select": "@n", "target_select": "@k"}, {"type": "IN", "kind": "parent", "from": "site", "to": "part"}],
}
TYPES, RELATIONS = {"Site": {"Name": True}, "Motor": {"Weight": False}}, {"NEXT": [("Motor", "Motor")], "IN": [("Site", "Motor")]}
SOURCE = """<r><site k="A" name="one">
<part k="1" s="s" t="m" w="5 kg" n="2"/><part k="2" s="s" t="m" w="5 lb" n=""/><part k="3" s="s" t="m" n="9"/><part k="4" s="s" t="m" n="5"><w>7</w></part>
<part k="5" s="s" t="m" w="1kg"><w>2</w></part><part k="5" s="z" t="m"/><part k="6" s=" " t="m"/><part s="s" t="m"/><part k="7" s="s" t="m" x="1"/><part k="8" s="s" t="q"/><part k="9" s="s" t="u"/>
<part k="10" s="s" t="m" o="x"/></site><site k="B"><site k="C" name="deep"><part k="1" s="s" t="m"/></site></site><site k="D" name="a"/><site k="D" name="b"><part k="1" s="s" t="m"/></site><part k="1" s="s" t="m"/></r>"""


def identity(collection: str, *parts: str) -> str:
    return "xml:" + hashlib.sha256(json.dumps({"collection": collection, "parts": list(parts)}, separators=(",", ":")).encode()).hexdigest()


def test_a_mapping_and_its_faults(spark):
    rows = [(1, SOURCE), (2, "<r><site"), (3, None), (4, "<r/>")]
    nodes = structured.locate_xml(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "path", "kind", "value", "char_start", "char_end")
    out = xml_mapping.map_xml(nodes, MAPPING, TYPES, RELATIONS)
    a, c = identity("site", "A"), identity("site", "C")
    part = lambda k, s="s", owner=a: identity("part", owner, s, k)
    entities = {(r.path, r.identity) for r in out["entities"].collect()}
    site = "/r/site[1]"
    assert entities == {
        (site, a), ("/r/site[2]", identity("site", "B")), ("/r/site[2]/site[1]", c), ("/r/site[2]/site[1]/part[1]", part("1", owner=c)),
        *((f"{site}/part[{k}]", part(str(k))) for k in range(1, 6)), (f"{site}/part[6]", part("5", "z")), (f"{site}/part[12]", part("10")),
    }
    said: dict[str, set] = {}
    for r in out["diagnostics"].collect():
        said.setdefault(r.code, set()).add((r.id, r.path))
    p = lambda *ks: {(1, f"{site}/part[{k}]") for k in ks}
    last = (1, "/r/site[4]/part[1]")
    assert said == {
        "XML_SOURCE_INVALID": {(2, ""), (3, "")}, "XML_IDENTITY_DUPLICATE": {(1, "/r/site[3]"), (1, "/r/site[4]")}, "XML_REQUIRED_PROPERTY_MISSING": {(1, "/r/site[2]")},
        "XML_TYPE_AMBIGUOUS": p(9), "XML_TYPE_UNMAPPED": p(10), "XML_TYPE_UNDECLARED": p(11), "XML_IDENTITY_INVALID": p(7, 8), "XML_IDENTITY_OWNER_MISSING": {last, (1, "/r/part[1]")},
        "XML_QUANTITY_INVALID": {(1, f"{site}/part[2]/@w")}, "XML_PROPERTY_DUPLICATE": p(5), "XML_PROPERTY_UNDECLARED": {(1, f"{site}/part[12]/@o")},
        "XML_REFERENCE_UNRESOLVED": {(1, f"{site}/part[3]/@n")}, "XML_REFERENCE_AMBIGUOUS": {(1, f"{site}/part[4]/@n")},
    }
    properties = {(r.identity, r.property, r.value, r.unit) for r in out["properties"].collect()}
    assert properties == {(a, "Name", "one", None), (c, "Name", "deep", None), (part("1"), "Weight", "5", "kg"), (part("4"), "Weight", "7", None), (part("5"), "Weight", "1", "kg"), (part("5"), "Weight", "2", None)}
    relations = {(r.type, r.source, r.target) for r in out["relationships"].collect()}
    assert relations == {("NEXT", part("1"), part("2")), ("IN", c, part("1", owner=c)), *(("IN", a, part(str(k))) for k in (1, 2, 3, 4, 5, 10)), ("IN", a, part("5", "z"))}
    unmapped = {r.path.split("/", 2)[-1] for r in out["coverage"].filter("disposition = 'unmapped'").collect()}
    assert unmapped >= {"site[1]/part[2]/@w", "site[1]/part[12]/@o"} and "site[1]/part[1]/@w" not in unmapped
    empty = xml_mapping.map_xml(nodes.limit(0), MAPPING, TYPES, RELATIONS)
    assert all(df.count() == 0 for df in empty.values())
