"""Similar names against brute force, and the steps of the ladder."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from graphloom.operators import resolution


def brute(names: list[tuple], authorities: list[tuple], least: float, most: int) -> set[tuple]:
    out = set()
    for i, x in names:
        found = [(-round(SequenceMatcher(None, x, y).ratio(), 6), j) for j, y in authorities]
        found = sorted(f for f in found if -f[0] >= least)
        out |= {(i, j, -r, k + 1) for k, (r, j) in enumerate(found[:most])}
    return out


@pytest.mark.parametrize("least", [0.84, 0.5, 0.1])
def test_similar_names_equal_brute_force(spark, least):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéü日") for _ in range(rng.randint(3, 9)))
    known = [word() + (" " + word() if rng.random() < 0.5 else "") for _ in range(40)] + ["", "germany", "ab" * 130 + "c"]
    names = [w[:k] + w[k + 1 :] for w in known if w for k in [rng.randrange(len(w))]] + ["germani", "", *known[:5]]
    names, known = list(enumerate(names)), list(enumerate(known))
    n, a = spark.createDataFrame(names, "id long, name_key string"), spark.createDataFrame(known, "authority_id int, authority_key string")
    got = {tuple(r) for r in resolution.similar_names(n, a, least, 3).collect()}
    assert got == brute(names, known, least, 3)


def numbered(rng: random.Random, n: int, least_id: int) -> list[tuple]:
    """Names that are told apart by digits, of several lengths and frames; some twice, some ids twice."""
    out = []
    for i in range(n):
        frame = rng.choice(["party {}", "party {}", "partner {}", "plant {} b"])
        out.append((least_id + i - i % 7 // 6, frame.format(str(rng.randrange(10**5)).zfill(rng.choice([5, 5, 6])))))
    return out + [(least_id + n + k, out[k][1]) for k in range(9)]


@pytest.mark.parametrize("least", [0.84, 0.7])
def test_nearest_of_numbered_names_equals_brute_force(spark, least):
    rng = random.Random(11)
    names, known = [*numbered(rng, 260, 0), (900, ""), (901, None)], [*numbered(rng, 200, 500), (3, "ab" * 130 + "c"), (2, "ab" * 130 + "c"), (1, "")]
    names.append((902, "ab" * 130 + "d"))
    rng.shuffle(known)
    n, a = spark.createDataFrame(names, "id long, name_key string"), spark.createDataFrame([(str(i), k) for i, k in known], "authority_id string, authority_key string")
    got = {tuple(r) for r in resolution.similar_names(n, a, least, 1).collect()}
    found = {}
    for i, j, ratio, _ in brute([x for x in names if x[1] is not None], [(str(i), k) for i, k in known], least, 1):
        found[i] = min(found.get(i, (0, "")), (-ratio, j))  # rows that share an id are ranked together
    assert got == {(i, j, -unlike, 1) for i, (unlike, j) in found.items()}


def _shuffled_rows(spark) -> int:
    jvm, context = spark._jvm, spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_names_that_differ_in_digits_are_not_all_paired(spark):
    names = spark.range(2000, 6000).selectExpr("id", "concat('party ', lpad(id, 9, '0')) AS name_key")
    known = spark.range(0, 2000).selectExpr("id AS authority_id", "concat('party ', lpad(id, 9, '0')) AS authority_key")
    before = _shuffled_rows(spark)
    found = resolution.similar_names(names, known, 0.84, 1).collect()
    assert len(found) == 4000
    # Without a bound, nearly each name would meet some hundred of others.
    assert _shuffled_rows(spark) - before < 60 * 6000


def test_tables_that_grow_with_the_names_are_not_broadcast(spark, monkeypatch):
    # Names that are much alike make small files, whatever their number; sent to all, they filled the driver.
    plans, plain = [], resolution.stage

    def planned(rows, label):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return plain(rows, label)

    monkeypatch.setattr(resolution, "stage", planned)
    names = spark.range(2000, 2400).selectExpr("id", "concat('party ', lpad(id, 9, '0')) AS name_key")
    known = spark.range(0, 300).selectExpr("id AS authority_id", "concat('party ', lpad(id, 9, '0')) AS authority_key")
    plans.append(resolution.similar_names(names, known, 0.84, 1)._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "Join [" in line]
    assert [line for line in joins if "SortMergeJoin [rest#" in line]
    assert not [line for line in joins if any(f"HashJoin [{key}#" in line for key in ("a", "b", "rest", "bag_a", "bag_b"))]


def test_authorities_of_one_name_do_not_multiply_its_finds(spark):
    names = spark.range(300).selectExpr("id", "'party 1234' AS name_key")
    known = spark.range(300).selectExpr("id + 5 AS authority_id", "'party 1235' AS authority_key")
    found = resolution.similar_names(names, known, 0.84, 2).collect()
    assert {(r.authority_id, r.ratio, r.rank) for r in found} == {(5, 0.9, 1), (6, 0.9, 2)} and len(found) == 600


PARTY = "id long, code string, identity string, name string, aliases array<string>"


def test_each_step_of_the_ladder(spark):
    authorities = spark.createDataFrame([
        (1, "k1", "i1", "Acme Works", ["ACME"]), (2, "k2", "i2", "Bolt and Nut", ["twin"]), (3, "k3", "i3", "Cable House", ["twin"]),
        (4, "k4", "i4", "Same", []), (5, "k5", "i4", "Same", None), (6, "k6", None, "Elsewhere Ltd", ["Zanzibar trading"]),
    ], PARTY)
    rows = [
        (10, "k1", None, "x", None), (11, "z", "i2", "acme", None), (12, "z", None, "other", ["Twin"]), (13, "z", None, "CABLE-house", None),
        (14, "z", None, "same", []), (15, "z", "i4", "Cabel House", None), (16, None, "i9", "nothing like it", None), (17, "z", "i1", "zanzibar tradin", None),
    ]
    candidates = spark.createDataFrame(rows, PARTY)
    got = {r.candidate_id: (r.step, r.match_id, r.confidence) for r in resolution.full_ladder(candidates, authorities).collect()}
    ratio = lambda a, b: round(SequenceMatcher(None, a, b).ratio(), 6)
    assert got == {
        10: ("CANONICAL_KEY", 1, 1.0), 11: ("GOVERNED_ALIAS", 1, 0.995), 12: ("CONFLICT", None, None), 13: ("EXACT_NAME", 3, 0.98),
        14: ("CONFLICT", None, None), 15: ("SIMILAR_NAME", 3, ratio("cabel house", "cable house")), 16: ("NO_MATCH", None, None),
        17: ("SIMILAR_NAME", 6, ratio("zanzibar tradin", "zanzibar trading")),
    }
    got = {r.candidate_id: (r.step, r.match_id) for r in resolution.full_ladder(candidates, authorities, identified=True).collect()}
    assert got == {
        10: ("CANONICAL_KEY", 1), 11: ("IDENTITY_PROPERTIES", 2), 12: ("CONFLICT", None), 13: ("CONFLICT", None), 14: ("CONFLICT", None),
        15: ("CONFLICT", None), 16: ("NO_MATCH", None), 17: ("IDENTITY_PROPERTIES", 1),
    }
