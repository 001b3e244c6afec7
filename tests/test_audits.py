"""Audits of hierarchies deeper than the supplied tables have."""

from __future__ import annotations

import pytest

from graphloom.operators import published_audit
from graphloom.operators import quality_audit as audit
from graphloom.plans import publication_queries

SF = "/root/testdata/sf0.001"

CHAIN = [(f"n{i + 1}", f"n{i}") for i in range(99)]
RING = [("a", "b"), ("b", "c"), ("c", "a")]


def test_a_chain_of_100_nodes_is_not_cyclic_and_keeps_its_depths(spark):
    edges = spark.createDataFrame(CHAIN, "child string, parent string")
    assert audit.in_cycles(edges).collect() == []
    got = {(r.node, r.depth, r.root) for r in audit.hierarchy(edges, spark).collect()}
    assert got == {(f"n{i}", i, "n0") for i in range(100)}


def test_a_ring_below_a_root_ends(spark):
    edges = spark.createDataFrame([("x", "root"), ("a", "x"), *RING, ("below", "a")], "child string, parent string")
    assert {r.node for r in audit.in_cycles(edges).collect()} == {"a", "b", "c"}
    assert {(r.node, r.depth) for r in audit.hierarchy(edges, spark).collect()} == {("root", 0), ("x", 1)}


def _shuffled(frame) -> int:
    """How many exchanges by key a frame's plan has."""
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rules_on_one_revision_shuffle_nothing_and_the_others_their_own_tables(spark):
    t = publication_queries.published(spark, SF)
    plan = lambda *codes: _shuffled(published_audit.revision_findings(t, publication_queries.PUBLICATION, codes))
    for code in ("REVISION_STATUS_INVALID", "ENTITY_NAMESPACE_INVALID", "ENTITY_TYPE_UNDECLARED", "ASSERTION_SUBJECT_SCHEMA_INVALID", "ASSERTION_OBJECT_KIND_INVALID"):
        assert plan(code) == 0, code
    assert plan("ACTIVE_ASSERTION_PROJECTION_INVALID") <= 2 and plan("ACTIVE_MENTION_PROJECTION_INVALID", "PUBLICATION_RECORD_KIND_INVALID") <= 2
    with pytest.raises(ValueError, match="unknown"):
        plan("NO_SUCH_RULE")


def test_each_rule_by_itself_finds_what_it_finds_among_all(spark):
    t = publication_queries.published(spark, SF)
    found = lambda *codes: sorted(map(tuple, published_audit.revision_findings(t, publication_queries.PUBLICATION, *codes).collect()))
    whole = found()
    assert len(whole) == len(set(whole)) and {r[0] for r in whole} <= published_audit.REVISION_CODES.keys()
    for code in ("OBJECT_MENTION_LINK_INVALID", "SUBJECT_MENTION_LINK_INVALID", "HEAD_CURRENT_REVISION_INVALID"):
        assert found([code]) == [r for r in whole if r[0] == code]
