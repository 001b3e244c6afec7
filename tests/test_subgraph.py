"""Who may read what, which evidence holds, and budgets: each rule by rows that it alone excludes."""

from __future__ import annotations

import datetime

import pytest

from graphloom.operators import access, subgraph

WHO = access.Principal("t", ("g", "h"))
DAY = datetime.datetime(2024, 1, 1)
DOC = {"document_id": "d", "tenant_id": "t", "access_groups": ["g", "x"], "policy_id": "p", "policy_version": 2, "lifecycle": None, "retirement_id": None}
VERSION = {"version_id": "v", "document_id": "d", "tenant_id": "t", "lifecycle": "ACTIVE", "retirement_id": None, "published_at": DAY}
SNAPSHOT = {"snapshot_id": "s", "document_id": "d", "version_id": "v", "tenant_id": "t", "build_state": "PUBLISHED", "retirement_id": None}
CHUNK = {"chunk_id": "c", "snapshot_id": "s", "document_id": "d", "version_id": "v", "tenant_id": "t", "access_groups": ["h"], "policy_id": "p", "policy_version": 2,
         "char_start": 10, "char_end": 30, "text": "alpha near beta word"}
KINDS = {
    "document": "document_id string, tenant_id string, access_groups array<string>, policy_id string, policy_version int, lifecycle string, retirement_id string",
    "version": "version_id string, document_id string, tenant_id string, lifecycle string, retirement_id string, published_at timestamp",
    "snapshot": "snapshot_id string, document_id string, version_id string, tenant_id string, build_state string, retirement_id string",
    "chunk": "chunk_id string, snapshot_id string, document_id string, version_id string, tenant_id string, access_groups array<string>, policy_id string, policy_version int, char_start int, char_end int, text string",
}
#: Each breaks one rule of the chain.
BROKEN = [
    ("document", {"tenant_id": "u"}), ("document", {"access_groups": ["x"]}), ("document", {"access_groups": None}), ("document", {"policy_id": "q"}), ("document", {"policy_version": 1}),
    ("document", {"policy_id": None}), ("document", {"lifecycle": "RETIRED"}), ("document", {"retirement_id": "r"}), ("version", {"tenant_id": "u"}), ("version", {"lifecycle": "DRAFT"}),
    ("version", {"retirement_id": "r"}), ("version", {"document_id": "e"}), ("version", {"published_at": DAY + datetime.timedelta(days=9)}), ("version", {"published_at": None}),
    ("snapshot", {"tenant_id": "u"}), ("snapshot", {"build_state": "BUILDING"}), ("snapshot", {"retirement_id": "r"}), ("snapshot", {"document_id": "e"}), ("snapshot", {"version_id": "w"}),
    ("chunk", {"tenant_id": "u"}), ("chunk", {"access_groups": ["x"]}), ("chunk", {"access_groups": []}), ("chunk", {"document_id": "e"}), ("chunk", {"version_id": "w"}), ("chunk", {"snapshot_id": "z"}),
]


def chain(spark, change=None):
    rows = {"document": DOC, "version": VERSION, "snapshot": SNAPSHOT, "chunk": CHUNK}
    if change:
        rows = rows | {change[0]: rows[change[0]] | change[1]}
    return [spark.createDataFrame([tuple(rows[k].values())], KINDS[k]) for k in rows]


def test_each_rule_of_the_chain_excludes(spark):
    read = lambda tables, **more: access.readable_chunks(*tables, WHO, published_until="2024-01-05", **more).count()
    assert read(chain(spark)) == 1 and read(chain(spark, ("snapshot", {"build_state": "RETIRED"}))) == 1
    # All faults at once, told apart by their ids, so that one job shows them.
    tables: dict[str, list] = {k: [] for k in KINDS}
    for n, (table, change) in enumerate(BROKEN):
        for name, row in (("document", DOC), ("version", VERSION), ("snapshot", SNAPSHOT), ("chunk", CHUNK)):
            row = row | (change if name == table else {})
            tables[name].append(tuple(f"{v}{n}" if k in ("document_id", "version_id", "snapshot_id", "chunk_id") else v for k, v in row.items()))
    assert read([spark.createDataFrame(tables[k], KINDS[k]) for k in KINDS]) == 0
    assert read(chain(spark), document_ids=["e"]) == 0 and read(chain(spark), version_ids=["v"]) == 1
    assert access.readable_chunks(*chain(spark), WHO).columns == list(CHUNK)


EVIDENCE = {"revision_id": "m", "tenant_id": "t", "status": "PUBLISHED", "authority": "AUTHORITATIVE", "ontology": "o", "entity_id": "e1", "entity_type": "T", "chunk_id": "c", "document_id": "d",
            "version_id": "v", "policy_id": "p", "policy_version": 2, "access_groups": ["h"], "char_start": 10, "char_end": 15, "quoted": "alpha"}
_KIND = ("revision_id string, tenant_id string, status string, authority string, ontology string, {} chunk_id string, document_id string, version_id string, policy_id string, policy_version int, "
         "access_groups array<string>, char_start int, char_end int, quoted string")
MENTION_KIND = _KIND.format("entity_id string, entity_type string,")
ASSERTION_KIND = _KIND.format("predicate string, subject_id string, subject_mention string, object_kind string, object_id string, object_mention string, literal string,")
ASSERTION = {k: v for k, v in EVIDENCE.items() if not k.startswith("entity")} | {"revision_id": "a", "char_end": 25, "quoted": "alpha near beta"}
ENDS = {"predicate": "NEAR", "subject_id": "e1", "subject_mention": "m", "object_kind": "entity", "object_id": "e2", "object_mention": "n", "literal": None}
MENTION_FAULTS = [
    {"tenant_id": "u"}, {"status": "APPROVED"}, {"authority": "CANDIDATE"}, {"authority": None}, {"ontology": "o1"}, {"entity_type": "U"}, {"entity_id": "e9"}, {"chunk_id": "c2"}, {"document_id": "d2"},
    {"version_id": "v2"}, {"policy_id": "p2"}, {"policy_version": 1}, {"access_groups": ["g"]}, {"access_groups": None}, {"quoted": "alphA"}, {"char_start": 9, "char_end": 14},
    {"char_end": 10, "quoted": ""}, {"char_start": 26, "char_end": 31, "quoted": "word"},
]
ASSERTION_FAULTS = [
    {"status": "DRAFT"}, {"authority": "CANDIDATE"}, {"ontology": "x"}, {"predicate": "FAR"}, {"subject_id": "e2"}, {"subject_mention": "n"}, {"object_id": "e1"}, {"object_mention": None}, {"object_mention": "far"},
    {"char_end": 24, "quoted": "alpha near bet"}, {"char_start": 11, "quoted": "lpha near beta"}, {"quoted": "alpha near BETA"}, {"object_kind": "thing"}, {"policy_version": 3},
    {"object_kind": "literal"}, {"object_kind": "literal", "object_id": None, "object_mention": None, "predicate": "Code", "literal": ""},
    {"object_kind": "literal", "object_id": None, "object_mention": None, "predicate": "Code", "literal": "absent"}, {"object_kind": "literal", "object_id": None, "object_mention": None, "literal": "near"},
]


def test_each_rule_of_evidence_excludes(spark):
    chunks = chain(spark)[3]
    second = EVIDENCE | {"revision_id": "n", "entity_id": "e2", "char_start": 21, "char_end": 25, "quoted": "beta"}
    rows = [EVIDENCE, second] + [EVIDENCE | {"revision_id": f"x{n}"} | fault for n, fault in enumerate(MENTION_FAULTS)]
    mentions = spark.createDataFrame([tuple(r.values()) for r in rows], MENTION_KIND)
    entities = spark.createDataFrame([("e1", "T"), ("e2", "T"), ("e9", "U")], "entity_id string, entity_type string")
    types = spark.createDataFrame([("T",)], "name string")
    held = subgraph.governed_mentions(mentions, entities, types, chunks, WHO, "AUTHORITATIVE_AND_SECONDARY", "o")
    assert sorted(r.revision_id for r in held.collect()) == ["m", "n"]
    order = [k.split()[0] for k in ASSERTION_KIND.split(", ")]
    literal = {"revision_id": "l", "object_kind": "literal", "object_id": None, "object_mention": None, "predicate": "Code", "literal": "near"}
    rows = [ASSERTION | ENDS, ASSERTION | ENDS | literal] + [ASSERTION | ENDS | {"revision_id": f"x{n}"} | fault for n, fault in enumerate(ASSERTION_FAULTS)]
    assertions = spark.createDataFrame([tuple(r[k] for k in order) for r in rows], ASSERTION_KIND)
    relations = spark.createDataFrame([("NEAR", "T", "T")], "name string, source_type string, target_type string")
    properties = spark.createDataFrame([("T", "Code")], "entity_type string, name string")
    got = subgraph.governed_assertions(assertions, held, relations, properties, chunks, WHO, "AUTHORITATIVE_AND_SECONDARY", "o")
    assert sorted(r.revision_id for r in got.collect()) == ["a", "l"]


def row(kind, revision, *ends, chunk="c", size=10, seed=None, evidence=None):
    ends = [(e, r, chunk) for e, r in ends]
    return {"kind": kind, "seed": seed, "seed_chunk": "c", "chunk_id": chunk, "chunk_size": size, "ends": ends, "evidence": evidence or [(revision, 0, 5)]}


@pytest.mark.parametrize(("limits", "rows", "want"), [
    ({"entities": 1}, [row("mention", "m1", ("a", "m1")), row("mention", "m2", ("b", "m2"))], ["admitted", "entity_limit"]),
    ({"mentions_per_entity": 1}, [row("mention", "m1", ("a", "m1")), row("mention", "m2", ("a", "m2"))], ["admitted", "mention_limit"]),
    # A chunk's characters count once, each piece of evidence too.
    ({"evidence_chars": 20}, [row("mention", "m1", ("a", "m1")), row("mention", "m2", ("b", "m2")), row("mention", "m3", ("b", "m3"))], ["admitted", "admitted", "character_budget"]),
    ({"assertions": 1}, [row("mention", "m1", ("a", "m1")), *[row("assertion", f"r{k}", ("a", "m1"), ("b", "n1"), seed="a") for k in (1, 2)]], ["admitted", "admitted", "assertion_limit"]),
    ({"entities": 1}, [row("mention", "m1", ("a", "m1")), row("mention", "m2", ("b", "m2")), row("assertion", "r", ("b", "m2"), seed="b")], ["admitted", "entity_limit", "seed_not_admitted"]),
    # Both ends or none: the subject would fit, the object doesn't.
    ({"entities": 1}, [row("mention", "m1", ("a", "m1")), row("assertion", "r", ("a", "m1"), ("b", "n1"), seed="a")], ["admitted", "entity_limit"]),
    ({"mentions_per_entity": 1}, [row("mention", "m1", ("a", "m1")), row("assertion", "r", ("a", "m1"), ("a", "n1"), seed="a")], ["admitted", "mention_limit"]),
    # What a limit keeps out takes no room.
    ({"evidence_chars": 30}, [row("mention", "m1", ("a", "m1")), row("mention", "m2", ("b", "m2"), chunk="d", size=90), row("mention", "m3", ("e", "m3"))], ["admitted", "character_budget", "admitted"]),
])
def test_each_budget_bites(limits, rows, want):
    assert subgraph.admit(rows, subgraph.Limits(**limits)) == want


def test_limits_are_positive():
    with pytest.raises(ValueError, match="positive"):
        subgraph.Limits(paths=0)
