"""Commits: what is visible, who wins, what is refused, and that nothing half done is ever seen."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from graphloom import staging, store
from graphloom.operators import ledger as module
from graphloom.operators.ledger import Ledger, Refused, advanced, navigation
from graphloom.plans import ledger_queries

KIND = "id string, value int"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), KIND)


def seen(ledger, name="t"):
    found = ledger.table(name)
    return None if found is None else sorted(tuple(r) for r in found.collect())


def test_loads_are_idempotent_and_refuse_what_differs(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/l")
    assert ledger.head()["generation"] == 0 and seen(ledger) is None
    assert ledger.load("t", rows(spark, ("a", 1), ("b", None), ("a", 1)), "id", "one") == 1
    assert seen(ledger) == [("a", 1), ("b", None)]
    assert ledger.load("t", rows(spark, ("b", None), ("a", 1)), "id", "one") == 1 and len(ledger.history()) == 1
    assert ledger.load("t", rows(spark, ("b", None), ("c", 3)), "id", "two", expected=1) == 2
    assert seen(ledger) == [("a", 1), ("b", None), ("c", 3)]
    for wrong, code, ids in (
        ([("a", 2), ("d", 4)], "DIFFERING_ROWS", ("a",)), ([("d", 4), ("d", 5), ("e", 1)], "DIFFERING_ROWS", ("d",)), ([(None, 4), ("d", 1)], "NULL_KEY", ("null",)),
    ):
        with pytest.raises(Refused, match=code) as refused:
            ledger.load("t", rows(spark, *wrong), "id", "three")
        assert refused.value.ids == ids and refused.value.count == 1
    with pytest.raises(Refused, match="OPERATION_CONFLICT"):
        ledger.load("t", rows(spark, ("z", 0)), "id", "one")
    with pytest.raises(Refused, match="GENERATION_CONFLICT"):
        ledger.load("t", rows(spark, ("z", 0)), "id", "four", expected=1)
    assert seen(ledger) == [("a", 1), ("b", None), ("c", 3)] and ledger.head()["generation"] == 2
    assert ledger.load("t", rows(spark).limit(0), "id", "empty") == 3 and len(seen(ledger)) == 3
    assert ledger.compact("t") == 4 and len(ledger.head()["tables"]["t"]) == 1 and len(seen(ledger)) == 3
    # An earlier state stays readable.
    assert len(ledger.table("t", ledger._states()[0]).collect()) == 2


def test_retired_rows_stay_but_are_not_active(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/l")
    ledger.load("t", rows(spark, ("a", 1), ("b", 2), ("c", 3)), "id", "load")
    assert ledger.retire("t", rows(spark, ("a", 1)), "id", "value", "first") == 2
    assert ledger.retire("t", rows(spark, ("a", 1)), "id", "value", "first") == 2
    for wrong, code in (([("a", 1)], "RETIRED"), ([("b", 9)], "VERSION_CONFLICT"), ([("b", 2), ("z", 1)], "NOT_FOUND")):
        with pytest.raises(Refused, match=code):
            ledger.retire("t", rows(spark, *wrong), "id", "value", "other")
    with pytest.raises(Refused, match="RETIRED"):
        ledger.load("t", rows(spark, ("a", 1), ("d", 4)), "id", "again")
    assert sorted(r.id for r in ledger.active("t", "id").collect()) == ["b", "c"] and len(seen(ledger)) == 3


def test_of_two_writers_on_one_generation_one_wins(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/l")
    ledger.load("t", rows(spark, ("a", 1)), "id", "base")
    results: dict[int, object] = {}
    gate = threading.Barrier(2)

    def write(k: int) -> None:
        own = Ledger(spark, f"{tmp_path}/l")
        commit = own._commit

        def together(*args, **kwargs):
            gate.wait()
            return commit(*args, **kwargs)

        own._commit = together
        try:
            results[k] = own.load("t", rows(spark, (f"w{k}", k)), "id", f"writer {k}", expected=1)
        except Refused as refused:
            results[k] = refused.code

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, results.values())) == ["2", "GENERATION_CONFLICT"]
    winner = next(k for k, v in results.items() if v == 2)
    assert seen(ledger) == [("a", 1), (f"w{winner}", winner)] and ledger.sweep() == 1
    # The loser reads the new state and does it again.
    assert ledger.load("t", rows(spark, ("x", 7)), "id", f"writer {3 - winner}", expected=2) == 3


def test_a_writer_lost_before_publishing_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, f"{tmp_path}/l")
    ledger.load("t", rows(spark, ("a", 1)), "id", "base")

    def lost(*_):
        raise OSError("lost")

    monkeypatch.setattr(store, "publish_new", lost)
    with pytest.raises(OSError, match="lost"):
        ledger.load("t", rows(spark, ("b", 2)), "id", "more")
    assert seen(ledger) == [("a", 1)] and ledger.head()["generation"] == 1
    monkeypatch.undo()
    assert ledger.load("t", rows(spark, ("b", 2)), "id", "more") == 2 and seen(ledger) == [("a", 1), ("b", 2)]
    assert ledger.sweep() == 1 and seen(ledger) == [("a", 1), ("b", 2)]
    digest = module._digest
    calls = iter(range(9))
    monkeypatch.setattr(module, "_digest", lambda r: (*digest(r)[:2], next(calls)))
    with pytest.raises(Refused, match="VERIFICATION_FAILED"):
        ledger.load("t", rows(spark, ("c", 3)), "id", "damaged")
    monkeypatch.undo()
    assert len(seen(ledger)) == 2 and ledger.sweep() == 0


RECORD = "record_id string, revision int, subject string, predicate string, object string, chunk_id long"


def test_publications_advance_and_go_back(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/l")
    records = spark.createDataFrame([
        ("r1", 1, "a", "P", "b", 5), ("r1", 2, "a", "P", "c", 4), ("r2", 1, "a", "P", "b", 3), ("r3", 1, "b", "P", "c", 2), ("r4", 1, "x", "Q", "y", 1), ("r5", 1, None, "P", "y", 1),
    ], RECORD)
    members = lambda *m: spark.createDataFrame(list(m), "record_id string, revision int")
    fine = lambda found: found.filter("subject IS NULL")
    graph = lambda: {tuple(r) for r in ledger.graph().collect()}
    anew = lambda *m: {tuple(r) for r in navigation(records.join(members(*m), ["record_id", "revision"], "left_semi")).collect()}
    one, two, three = (("r1", 1), ("r2", 1), ("r3", 1)), (("r1", 2), ("r2", 1), ("r4", 1)), (("r4", 1),)
    assert ledger.publish("one", members(*one), records, fine, None) == 1
    assert graph() == anew(*one) == {("a", "P", "b", 2, 3), ("b", "P", "c", 1, 2)}
    assert ledger.publish("two", members(*two), records, fine, "one") == 2 and graph() == anew(*two)
    assert ledger.publish("two", members(*two), records, fine, "one") == 2  # published already
    for publication, manifest, active, code in (
        ("three", three, "one", "ACTIVE_CONFLICT"), ("one", one, "two", "NOT_ACTIVE"), ("two", three, "two", "OPERATION_CONFLICT"), ("x", (("r1", 1), ("r1", 2)), "two", "DUPLICATE_RECORD"),
        ("x", (("r9", 1),), "two", "MEMBER_NOT_FOUND"), ("x", (("r5", 1),), "two", "INVALID_RECORDS"),
    ):
        with pytest.raises(Refused, match=code):
            ledger.publish(publication, members(*manifest), records, fine, active)
    assert graph() == anew(*two) and ledger.head()["active"] == "two"
    assert ledger.publish("three", members(*three), records, fine, "two") == 3 and graph() == anew(*three)
    # Going back validates what it goes back to by the rules of now.
    with pytest.raises(Refused, match="INVALID_RECORDS"):
        ledger.rollback("one", records, lambda found: found.filter("predicate = 'P'"), "three")
    with pytest.raises(Refused, match="ACTIVE_CONFLICT"):
        ledger.rollback("one", records, fine, "two")
    assert ledger.rollback("one", records, fine, "three") == 4 and graph() == anew(*one)
    assert ledger.rollback("one", records, fine, "one") == 4
    assert ledger.publish("four", members(*two, ("r3", 1)), records, fine, "one") == 5 and graph() == anew(*two, ("r3", 1))
    assert [h["action"] for h in ledger.history()] == ["PUBLISH", "PUBLISH", "PUBLISH", "ROLLBACK", "PUBLISH"]


def test_advancing_equals_making_anew(spark):
    import random

    rng = random.Random(4)
    records = spark.createDataFrame([(f"r{i}", v, f"s{rng.randrange(6)}", "P", f"o{rng.randrange(5)}", rng.randrange(99)) for i in range(80) for v in (1, 2, 3)], RECORD)
    some = lambda: spark.createDataFrame([(f"r{i}", rng.randint(1, 3)) for i in range(80) if rng.random() < 0.7], "record_id string, revision int")
    before, after = some(), some()
    of = lambda m: records.join(m, ["record_id", "revision"], "left_semi")
    got = advanced(navigation(of(before)), before, after, records)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, navigation(of(after)).collect()))
    assert advanced(navigation(of(before)), before, before.filter(F.lit(False)), records).count() == 0


def test_loads_tell_whole_rows_apart_only_where_keys_repeat(spark, tmp_path, monkeypatch):
    # One task's groups of whole rows grew with the load; now a load is stored as it comes, and distinct only if it has to be.
    plans, plain = [], module.stage

    def planned(rows, label):
        if label == "load":
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return plain(rows, label)

    monkeypatch.setattr(module, "stage", planned)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    made = Ledger(spark, f"file://{tmp_path}/l")
    assert made.load("t", rows, "id", "one") == 1 and len(plans) == 1 and "Aggregate" not in plans[0]
    assert made.load("t", rows.unionByName(rows), "id", "one") == 1 and len(plans) == 3  # repeated rows are the same load
    with pytest.raises(Refused, match="DIFFERING_ROWS"):
        made.load("t", rows.unionByName(rows.withColumn("v", F.lit(9))), "id", "two")
    assert sorted(tuple(r) for r in made.table("t").collect()) == [("a", 1), ("b", 2)]


def test_records_are_grouped_in_tasks_of_bounded_lines(spark, monkeypatch):
    monkeypatch.setattr(ledger_queries, "LINES_PER_TASK", 100)
    assert ledger_queries._records(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 60


def _written_rows(spark) -> int:
    jvm, context = spark._jvm, spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).outputRecords() for i in range(stages.size()))


def test_what_is_loaded_and_published_is_written_once(spark, tmp_path):
    # Loads were written three times and graphs twice, and what was staged for them stayed to the end.
    n, before, staged = 600, _written_rows(spark), len(staging._staged)
    rows = spark.range(n).selectExpr("cast(id AS string) AS record_id", "1 AS revision", "concat('s', id % 7) AS subject", "'P' AS predicate", "concat('o', id) AS object", "id AS chunk_id")
    made = Ledger(spark, f"{tmp_path}/l")
    made.load("records", rows, "record_id", "load")
    assert _written_rows(spark) - before == n
    records, before = made.table("records"), _written_rows(spark)
    fine = lambda found: found.filter("subject IS NULL")
    made.publish("one", records.select("record_id", "revision"), records, fine, None)
    assert _written_rows(spark) - before <= 3 * n  # the manifest, staged and stored, and the graph
    made.publish("two", records.filter("chunk_id % 2 = 0").select("record_id", "revision"), records, fine, "one")
    assert sorted(tuple(r) for r in made.graph().collect()) == sorted(tuple(r) for r in navigation(records.filter("chunk_id % 2 = 0")).collect())
    assert len(staging._staged) == staged
