"""Hierarchies by doubling against plain walks, and embedding generations."""

from __future__ import annotations

import random

import pytest

from graphloom.operators import hierarchies
from graphloom.operators.ledger import Generations, Ledger, Refused


def walks(edges: list[tuple]) -> tuple[dict, set]:
    parents: dict = {}
    for node, parent in edges:
        if node is not None:
            parents.setdefault(node, set())
            if parent is not None:
                parents[node].add(parent)
                parents.setdefault(parent, set())
    faults = {(n, "SEVERAL_PARENTS") for n, p in parents.items() if len(p) > 1} | {(n, "SELF_LOOP") for n, p in parents.items() if n in p}
    one = {n: (None if (n, "SEVERAL_PARENTS") in faults or (n, "SELF_LOOP") in faults else next(iter(p), None)) for n, p in parents.items()}
    found = {}
    for n in one:
        at, depth, seen = n, 0, {n}
        while one[at] is not None and one[at] not in seen:
            at, depth = one[at], depth + 1
            seen.add(at)
        if one[at] is None:
            found[n] = (at, depth)
        else:
            faults.add((n, "CYCLE"))
    return found, faults


def test_forests_equal_walks(spark):
    rng = random.Random(7)
    edges = [(i, rng.choice([None, rng.randrange(60), i - 1 if i else None])) for i in range(60)]
    edges += [(100, 100), (101, 5), (101, 6), (200, 201), (201, 202), (202, 200), (203, 200), (None, 3), (7, None), (101, 5), (300, None), (301, 101)]
    got, faults = hierarchies.forest(spark.createDataFrame(edges, "node long, parent long"))
    found, wrong = walks(edges)
    assert {r.node: (r.root, r.depth) for r in got.collect()} == found and {(r.node, r.code) for r in faults.collect()} == wrong
    empty = hierarchies.forest(spark.createDataFrame([], "node long, parent long"))
    assert [df.count() for df in empty] == [0, 0]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    stage = hierarchies.stage
    monkeypatch.setattr(hierarchies, "stage", lambda df, label: (rounds.append(label), stage(df, label))[1])
    n = 20_000
    chain = spark.range(n).selectExpr("id AS node", "CASE WHEN id > 0 THEN id - 1 END AS parent")
    found, faults = hierarchies.forest(chain)
    row = found.filter(f"node = {n - 1}").first()
    assert (row.root, row.depth) == (0, n - 1) and faults.count() == 0 and found.count() == n
    assert rounds.count("hierarchy-round") <= 16


def test_values_come_from_the_nearest_scope(spark):
    nodes = [("world", None), ("a", "world"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "world"), ("f", "e"), ("g", "f"), ("x", "y"), ("y", "x"), ("z", "y"), ("own", "x"), ("far", "d")]
    values = [("world", "W"), ("b", "B"), ("d", "B"), ("e", "1"), ("e", "2"), ("g", "G"), ("own", "O"), ("a", None), ("c", None), ("far", "F"), ("b", "B")]
    rows = hierarchies.inherited(spark.createDataFrame(nodes, "node string, parent string"), spark.createDataFrame(values, "node string, value string")).collect()
    got = {r.node: (r.value, r.origin, r.scope, r.code) for r in rows}
    assert got == {
        "world": ("W", "LOCAL", "world", None), "a": ("W", "INHERITED", "world", None), "b": ("B", "LOCAL", "b", "LOCAL_CONFLICT"), "c": ("B", "INHERITED", "b", None), "d": ("B", "LOCAL", "d", None),
        "e": (None, "MISSING", None, "SCOPE_AMBIGUOUS"), "f": (None, "MISSING", None, "SCOPE_AMBIGUOUS"), "g": ("G", "LOCAL", "g", None), "x": (None, "MISSING", None, "CYCLE"), "y": (None, "MISSING", None, "CYCLE"),
        "z": (None, "MISSING", None, "CYCLE"), "own": ("O", "LOCAL", "own", None), "far": ("F", "LOCAL", "far", "LOCAL_CONFLICT"),
    }
    rng = random.Random(3)
    nodes = [(i, rng.randrange(i) if i and rng.random() < 0.9 else None) for i in range(120)]
    values = {i: rng.choice("pq") for i in range(120) if rng.random() < 0.15}
    parent = dict(nodes)
    rows = hierarchies.inherited(spark.createDataFrame(nodes, "node int, parent int"), spark.createDataFrame(list(values.items()), "node int, value string")).collect()
    for r in rows:
        at = r.node
        while at is not None and at not in values:
            at = parent[at]
        assert (r.value, r.scope) == (values.get(at), at)


def test_generations_are_selected_when_they_cover_all(spark, tmp_path):
    kind = "chunk_id long, embedding array<float>"
    g = Generations(Ledger(spark, f"{tmp_path}/l"))
    active = spark.createDataFrame([(1,), (2,), (2,)], "chunk_id long")
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    with pytest.raises(Refused, match="NOT_PREPARED"):
        g.materialize("one", rows((1, [1.0])), "x")
    assert g.prepare("one", "s", 2) == 1 and g.prepare("one", "s", 2) == 1
    with pytest.raises(Refused, match="PROFILE_CONFLICT"):
        g.prepare("one", "s", 3)
    for wrong in ([1.0], [0.0, 0.0], None, [float("nan"), 1.0], [1.0, None], [float("inf"), 1.0]):
        with pytest.raises(Refused, match="INVALID_VECTORS") as refused:
            g.materialize("one", rows((1, [1.0, 2.0]), (7, wrong)), "wrong")
        assert refused.value.ids == (7,)
    g.materialize("one", rows((1, [1.0, 2.0]), (9, [1.0, 0.0])), "first")
    with pytest.raises(Refused, match="COVERAGE_INCOMPLETE") as refused:
        g.activate("one", active, None)
    assert refused.value.ids == (2,)
    g.materialize("one", rows((2, [0.5, 0.5]), (1, [1.0, 2.0])), "second")
    at = g.activate("one", active, None)
    assert g.ledger.head()["active_generation"] == "one" and g.activate("one", active, "one") == at
    g.prepare("two", "s", 2)
    g.materialize("two", rows((1, [1.0, 1.0]), (2, [1.0, 1.0])), "two")
    with pytest.raises(Refused, match="ACTIVE_CONFLICT"):
        g.activate("two", active, None)
    g.activate("two", active, "one")
    assert g.ledger.head()["active_generation"] == "two" and g.missing("two", active).count() == 0
