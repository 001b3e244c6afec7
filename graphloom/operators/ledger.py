"""Governed tables as a log of commits in the shared folder: idempotent loads, retirements, publications and rollbacks.

Data are written under new names, read back and verified, and become visible all at once by the commit that names them. A commit is one small
file whose name is the next generation, so of several writers that expect the same generation exactly one succeeds; what a lost writer
has left is named by no commit and never read. A commit holds the whole state: the files of each table, the operations done, the
publications and which of them is active. It grows with the loads, not with their rows; ``compact`` makes one file list of many.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom import store
from graphloom.staging import drop, many, sparing, stage, staged_path

EMPTY = {"generation": 0, "tables": {}, "schemas": {}, "operations": {}, "publications": {}, "active": None}
EDGE = ("subject", "predicate", "object")
#: A refusal names so many of the ids that it counts.
NAMED = 100


class Refused(ValueError):
    """An operation that changes nothing: its code, how many rows are at fault, and the first of their ids."""

    def __init__(self, code: str, count: int = 0, ids: tuple = ()):
        self.code, self.count, self.ids = code, count, ids
        super().__init__(f"{code}: {count} rows, {list(ids)[:5]}" if count else code)


def _digest(rows: DataFrame) -> tuple[int, int, int]:
    """Number and two order-free sums of hashes of the rows."""
    return tuple(rows.agg(*_marks(rows.columns)).first())


def _marks(columns: list[str], of: Column | None = None) -> list[Column]:
    """What ``_digest`` counts and sums of these columns, in the rows for which ``of`` holds if it is given."""
    own = [F.col(f"`{c}`") for c in columns]
    wanted = F.lit(True) if of is None else of
    mark = lambda seed: F.coalesce(F.bit_xor(F.when(wanted, F.xxhash64(F.lit(seed), *own))), F.lit(0))
    return [F.count_if(wanted).alias("n"), mark(0).alias("a"), mark(1).alias("b")]


def _seen(passed: Observation) -> tuple[int, int, int]:
    """The digest of the rows that have passed, once they have."""
    return tuple(passed.get[c] for c in ("n", "a", "b"))


def _refuse(rows: DataFrame, code: str, key: str) -> None:
    """Refuse if there are any rows; the driver gets their number and the first ids."""
    ids = rows.select(F.col(key).alias("id")).distinct()
    first = [r.id for r in ids.orderBy("id").limit(NAMED).collect()]
    if first:
        raise Refused(code, ids.count(), tuple(first))


def navigation(records: DataFrame) -> DataFrame:
    """(subject, predicate, object, n, evidence): the edges that records (subject, predicate, object, chunk_id) support, how often, and by which chunk first."""
    return records.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("evidence"))


def advanced(graph: DataFrame, before: DataFrame, after: DataFrame, records: DataFrame, seen: Observation | None = None) -> DataFrame:
    """The navigation graph of manifest ``after``, from that of ``before``: only edges that a changed record touches are made again.

    Manifests are (record_id, revision), records (record_id, revision, subject, predicate, object, chunk_id) in all revisions. Records are
    shuffled once, to their places in both manifests, and edges once, the graph's and the records' together. ``seen`` gets the digest of the members.
    """
    none = F.lit(None)
    places = before.select("record_id", F.col("revision").alias("old"), none.alias("new")).unionByName(after.select("record_id", none.alias("old"), F.col("revision").alias("new")))
    places = places.groupBy("record_id").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    found = records.select("record_id", "revision", *EDGE, "chunk_id").join(many(places), "record_id").filter("revision = old OR revision = new")
    member = F.coalesce(F.col("revision") == F.col("new"), F.lit(False))
    found = found.select("record_id", "revision", *EDGE, "chunk_id", member.alias("member"), F.coalesce(F.col("old") != F.col("new"), F.lit(True)).alias("touched"))
    if seen is not None:
        found = found.observe(seen, *_marks(["record_id", "revision"], F.col("member")))
    edges = found.select(*EDGE, "member", "touched", "chunk_id", none.alias("was"), none.alias("by")).unionByName(
        graph.select(*EDGE, none.alias("member"), none.alias("touched"), none.alias("chunk_id"), F.col("n").alias("was"), F.col("evidence").alias("by")))
    made = edges.groupBy(*EDGE).agg(
        F.coalesce(F.max("touched"), F.lit(False)).alias("touched"), F.count_if("member").alias("n"), F.min(F.when(F.col("member"), F.col("chunk_id"))).alias("evidence"),
        F.max("was").alias("was"), F.min("by").alias("by"))
    either = lambda again, kept: F.when(F.col("touched"), F.col(again)).otherwise(F.col(kept)).alias(again)
    return made.select(*EDGE, either("n", "was"), either("evidence", "by")).filter("n > 0")


class Ledger:
    """The commits under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _commit_path(self, generation: int) -> str:
        return f"{self.root}/commits/{generation:020d}.json"

    def head(self) -> dict:
        """The state after the last commit."""
        names = [n for n in store.names_in(self.spark, f"{self.root}/commits") if n.endswith(".json")]
        return json.loads(store.read_text(self.spark, f"{self.root}/commits/{names[-1]}")) if names else EMPTY

    def history(self) -> list[dict]:
        """What each commit did: (generation, action, operation)."""
        return [{k: s[k] for k in ("generation", "action", "operation")} for s in self._states()]

    def table(self, name: str, state: dict | None = None) -> DataFrame | None:
        """A table as the last commit (or a given state) has it; None if nothing was ever loaded."""
        state = state or self.head()
        if name not in state["schemas"]:
            return None
        schema = StructType.fromJson(state["schemas"][name])
        paths = state["tables"][name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _replayed(self, state: dict, operation: str, fingerprint: str) -> int | None:
        """The generation in which this operation was done; refused if the same name was given to another."""
        done = state["operations"].get(operation)
        if done and done[0] != fingerprint:
            raise Refused("OPERATION_CONFLICT")
        return done[1] if done else None

    def _new_path(self) -> str:
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame) -> str:
        """Rows under a new name, read back and verified against those that were written: they are told as they pass, computed once and stored once."""
        path, passed = self._new_path(), Observation()
        rows.observe(passed, *_marks(rows.columns)).write.parquet(path)
        return self._verified(path, rows.schema, _seen(passed))

    def _keep(self, rows: DataFrame, digest: tuple[int, int, int]) -> str:
        """Staged rows as they are, under a new name instead of a second time."""
        path = self._new_path()
        store.move(self.spark, staged_path(rows), path)
        return self._verified(path, rows.schema, digest)

    def _verified(self, path: str, schema: StructType, digest: tuple[int, int, int]) -> str:
        if _digest(self.spark.read.schema(schema).parquet(path)) != digest:
            store.remove(self.spark, path)
            raise Refused("VERIFICATION_FAILED")
        return path

    def _commit(self, state: dict, action: str, operation: str, fingerprint: str, **change) -> int:
        generation = state["generation"] + 1
        operations = state["operations"] | {operation: [fingerprint, generation]}
        new = state | change | {"generation": generation, "action": action, "operation": operation, "operations": operations}
        if not store.publish_new(self.spark, self._commit_path(generation), json.dumps(new, sort_keys=True)):
            raise Refused("GENERATION_CONFLICT")
        return generation

    def _expect(self, expected: int | None) -> dict:
        state = self.head()
        if expected is not None and state["generation"] != expected:
            raise Refused("GENERATION_CONFLICT")
        return state

    def load(self, name: str, rows: DataFrame, key: str, operation: str, expected: int | None = None) -> int:
        """Add rows to a table; the generation in which they are there.

        Rows that are there already, all columns alike, are not added again, and a repeated operation changes nothing. Refused, with the ids: a
        key with two different rows, here or in the table, null keys, keys that are retired, and an operation name that stood for other rows.
        """
        state = self._expect(expected)
        with sparing(self.spark):
            passed = Observation()
            given = stage(rows.observe(passed, *_marks(rows.columns)), "load")
            counted = given.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            repeated = not counted.isEmpty()
            # Only then are whole rows told apart, which takes as much memory as they do.
            rows = stage(given.distinct(), "load") if repeated else given
            try:
                return self._load(state, name, rows, key, operation, repeated, _seen(passed))
            finally:
                drop(given)
                drop(rows)

    def _load(self, state: dict, name: str, rows: DataFrame, key: str, operation: str, repeated: bool, passed: tuple[int, int, int]) -> int:
        fingerprint = "/".join(map(str, (name, *_digest(rows))))
        done = self._replayed(state, operation, fingerprint)
        if done:
            return done
        _refuse(rows.filter(F.col(key).isNull()).select(F.lit("null").alias(key)), "NULL_KEY", key)
        if repeated:
            _refuse(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "DIFFERING_ROWS", key)
        retired = self.table(f"{name}.retired", state)
        if retired is not None:
            _refuse(rows.join(many(retired.select(F.col("id").alias(key))), key, "left_semi"), "RETIRED", key)
        known = self.table(name, state)
        if known is not None:
            other = rows.join(many(known.select(key)), key, "left_semi").exceptAll(known)
            _refuse(other, "DIFFERING_ROWS", key)
            rows = rows.join(many(known.select(key)), key, "left_anti").select(*known.columns)
        path = self._keep(rows, passed) if known is None and not repeated and staged_path(rows) else self._write(rows)
        tables = state["tables"] | {name: [*state["tables"].get(name, []), path]}
        schemas = {name: rows.schema.jsonValue()} | state["schemas"]
        return self._commit(state, "LOAD", operation, fingerprint, tables=tables, schemas=schemas)

    def retire(self, name: str, asked: DataFrame, key: str, version: str, operation: str, expected: int | None = None) -> int:
        """Take rows out of what is active, by tombstones (id, version, operation); the rows stay for audits.

        ``asked`` has the key and the version that is expected there. Refused, with the ids: keys that aren't there, of another version, or retired.
        """
        state = self._expect(expected)
        with sparing(self.spark):
            asked = stage(asked.select(key, version).distinct(), "retire")
            try:
                return self._retire(state, name, asked, key, version, operation)
            finally:
                drop(asked)

    def _retire(self, state: dict, name: str, asked: DataFrame, key: str, version: str, operation: str) -> int:
        fingerprint = "/".join(map(str, ("retire", name, *_digest(asked))))
        done = self._replayed(state, operation, fingerprint)
        if done:
            return done
        known = self.table(name, state)
        if known is None:
            raise Refused("NOT_FOUND", 0)
        _refuse(asked.join(many(known.select(key)), key, "left_anti"), "NOT_FOUND", key)
        _refuse(asked.join(many(known.select(key, version)), [key, version], "left_anti"), "VERSION_CONFLICT", key)
        old = self.table(f"{name}.retired", state)
        if old is not None:
            _refuse(asked.join(many(old.select(F.col("id").alias(key))), key, "left_semi"), "RETIRED", key)
        rows = asked.select(F.col(key).alias("id"), F.col(version).alias("version"), F.lit(operation).alias("operation"))
        path, own = self._write(rows), f"{name}.retired"
        return self._commit(
            state, "RETIRE", operation, fingerprint, tables=state["tables"] | {own: [*state["tables"].get(own, []), path]},
            schemas={own: rows.schema.jsonValue()} | state["schemas"])

    def active(self, name: str, key: str) -> DataFrame:
        """The rows of a table that no tombstone names."""
        state = self.head()
        rows, retired = self.table(name, state), self.table(f"{name}.retired", state)
        return rows if retired is None else rows.join(many(retired.select(F.col("id").alias(key))), key, "left_anti")

    def compact(self, name: str) -> int:
        """One list of files for a table of many loads; its rows stay the same."""
        state = self.head()
        path = self._write(self.table(name, state))
        return self._commit(state, "COMPACT", f"compact-{uuid.uuid4().hex}", "", tables=state["tables"] | {name: [path]})

    def _check(self, manifest: DataFrame, records: DataFrame, validate: Callable[[DataFrame], DataFrame], there: bool = False) -> None:
        """Refuse a manifest that isn't ``there`` as a whole among the records, or has findings."""
        if not there:
            _refuse(manifest.join(many(records.select("record_id", "revision")), ["record_id", "revision"], "left_anti"), "MEMBER_NOT_FOUND", "record_id")
        _refuse(validate(records.join(many(manifest), ["record_id", "revision"], "left_semi")), "INVALID_RECORDS", "record_id")

    def publish(
        self, publication: str, manifest: DataFrame, records: DataFrame, validate: Callable[[DataFrame], DataFrame], expected_active: str | None
    ) -> int:
        """Make a manifest (record_id, revision) the active publication, if ``expected_active`` is that now; its navigation graph is advanced from that one's.

        Refused: another active publication, a record with several revisions, revisions that aren't among ``records``, findings of ``validate``
        (record_id, ...), and a publication id that stood for another manifest. The active publication published again changes nothing.
        """
        with sparing(self.spark):
            # One shuffle by record drops repeated members and counts a record's revisions.
            given = manifest.select("record_id", "revision")
            members = stage(given.repartition("record_id").distinct().groupBy("record_id").agg(F.min("revision").alias("revision"), F.count(F.lit(1)).alias("n")), "manifest")
            twice = members.filter("n > 1")
            members = members.select("record_id", "revision") if twice.isEmpty() else stage(given.distinct(), "manifest")
            try:
                return self._publish(publication, members, twice, records, validate, expected_active)
            finally:
                drop(twice)
                drop(members)

    def _publish(
        self, publication: str, manifest: DataFrame, twice: DataFrame, records: DataFrame, validate: Callable[[DataFrame], DataFrame], expected_active: str | None
    ) -> int:
        state, digest = self.head(), _digest(manifest)
        fingerprint = "/".join(map(str, ("publish", *digest)))
        if publication in state["publications"]:
            self._replayed(state, f"publish {publication}", fingerprint)
            if state["active"] != publication:
                raise Refused("NOT_ACTIVE")  # use rollback
            self._check(manifest, records, validate)
            return state["generation"]
        if state["active"] != expected_active:
            raise Refused("ACTIVE_CONFLICT")
        _refuse(twice, "DUPLICATE_RECORD", "record_id")
        seen = Observation()
        if state["active"] is None:
            members = records.select("record_id", "revision", *EDGE, "chunk_id").join(many(manifest), ["record_id", "revision"], "left_semi")
            graph = navigation(members.observe(seen, *_marks(["record_id", "revision"])))
        else:
            graph = advanced(self.graph(state), self.manifest(state), manifest, records, seen)
        path = self._write(graph)
        try:
            # The records that passed into the graph tell that the manifest is there; if they are more or others, both are compared.
            self._check(manifest, records, validate, there=_seen(seen) == digest)
        except Refused:
            store.remove(self.spark, path)
            raise
        own = {"manifest": self._write(manifest), "graph": path}
        schemas = {"manifest": manifest.schema.jsonValue(), "graph": graph.schema.jsonValue()} | state["schemas"]
        return self._commit(
            state, "PUBLISH", f"publish {publication}", fingerprint, publications=state["publications"] | {publication: own}, schemas=schemas, active=publication)

    def rollback(self, target: str, records: DataFrame, validate: Callable[[DataFrame], DataFrame], expected_active: str) -> int:
        """Make an earlier publication active again, if ``expected_active`` is that now and the target still holds by ``validate``."""
        state = self.head()
        if target not in state["publications"]:
            raise Refused("NOT_FOUND")
        if state["active"] != expected_active:
            raise Refused("ACTIVE_CONFLICT")
        with sparing(self.spark):
            self._check(self.manifest(state, target), records, validate)
        if state["active"] == target:
            return state["generation"]
        return self._commit(state, "ROLLBACK", f"rollback-{uuid.uuid4().hex} to {target}", "", active=target)

    def _of(self, part: str, state: dict | None, publication: str | None) -> DataFrame:
        state = state or self.head()
        path = state["publications"][publication or state["active"]][part]
        return self.spark.read.schema(StructType.fromJson(state["schemas"][part])).parquet(path)

    def manifest(self, state: dict | None = None, publication: str | None = None) -> DataFrame:
        """The members of a publication, the active one by default."""
        return self._of("manifest", state, publication)

    def graph(self, state: dict | None = None, publication: str | None = None) -> DataFrame:
        """The navigation graph of a publication, the active one by default."""
        return self._of("graph", state, publication)

    def sweep(self) -> int:
        """Delete data that no commit names (of writers that were lost); for times without writers. How many went."""
        named = {p.rsplit("/", 1)[-1] for s in self._states() for p in [x for paths in s["tables"].values() for x in paths] + [x for pub in s["publications"].values() for x in pub.values()]}
        lost = [n for n in store.names_in(self.spark, f"{self.root}/data") if n not in named]
        for n in lost:
            store.remove(self.spark, f"{self.root}/data/{n}")
        return len(lost)

    def _states(self) -> list[dict]:
        names = [n for n in store.names_in(self.spark, f"{self.root}/commits") if n.endswith(".json")]
        return [json.loads(store.read_text(self.spark, f"{self.root}/commits/{n}")) for n in names]


def inventory(entities: DataFrame, graph: DataFrame, literals: DataFrame) -> DataFrame:
    """(entity_id, entity_type, name, n_out, n_in, n_literals, evidence) of the entities that the active graph or a literal shows.

    entities (entity_id, entity_type, name); graph as ``navigation``; literals (subject, name, value). Evidence is the first chunk of any edge.
    """
    out = graph.groupBy(F.col("subject").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_out"), F.min("evidence").alias("evidence"))
    into = graph.groupBy(F.col("object").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_in"), F.min("evidence").alias("evidence"))
    facts = literals.distinct().groupBy(F.col("subject").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_literals"))
    parts = [out.select("entity_id", "n_out", F.lit(0).alias("n_in"), F.lit(0).alias("n_literals"), "evidence"),
             into.select("entity_id", F.lit(0).alias("n_out"), "n_in", F.lit(0).alias("n_literals"), "evidence"),
             facts.select("entity_id", F.lit(0).alias("n_out"), F.lit(0).alias("n_in"), "n_literals", F.lit(None).cast(dict(graph.dtypes)["evidence"]).alias("evidence"))]
    shown = reduce(DataFrame.unionByName, parts).groupBy("entity_id").agg(
        *[F.sum(c).alias(c) for c in ("n_out", "n_in", "n_literals")], F.min("evidence").alias("evidence"))
    return entities.join(many(shown), "entity_id").select("entity_id", "entity_type", "name", "n_out", "n_in", "n_literals", "evidence")


class Generations:
    """Embedding generations of a ledger: prepared, filled, and selected only when they cover all that is active."""

    def __init__(self, ledger: Ledger):
        self.ledger = ledger

    def _profiles(self, state: dict) -> dict:
        return state.get("generations", {})

    def prepare(self, generation: str, space: str, dimensions: int) -> int:
        """Declare a generation; the same again changes nothing, another profile under its name is refused."""
        state, profile = self.ledger.head(), {"space": space, "dimensions": dimensions}
        known = self._profiles(state).get(generation)
        if known and known != profile:
            raise Refused("PROFILE_CONFLICT")
        if known or dimensions < 1:
            if known:
                return state["generation"]
            raise Refused("PROFILE_INVALID")
        return self.ledger._commit(state, "PREPARE", f"prepare {generation}", json.dumps(profile), generations=self._profiles(state) | {generation: profile})

    def materialize(self, generation: str, rows: DataFrame, operation: str) -> int:
        """Add vectors (chunk_id, embedding); refused, with the ids, if any is null, of another length, or without a direction."""
        profile = self._profiles(self.ledger.head()).get(generation)
        if profile is None:
            raise Refused("NOT_PREPARED")
        squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        usable = (F.size("embedding") == profile["dimensions"]) & (squares > 0) & (squares < float("inf"))
        _refuse(rows.filter(~F.coalesce(usable, F.lit(False))), "INVALID_VECTORS", "chunk_id")
        return self.ledger.load(f"embeddings.{generation}", rows.select("chunk_id", "embedding"), "chunk_id", operation)

    def missing(self, generation: str, active: DataFrame) -> DataFrame:
        """(chunk_id): the active chunks that the generation has no vector of."""
        rows = self.ledger.table(f"embeddings.{generation}")
        ids = active.select("chunk_id").distinct()
        return ids if rows is None else ids.join(rows.select("chunk_id"), "chunk_id", "left_anti")

    def activate(self, generation: str, active: DataFrame, expected: str | None) -> int:
        """Select a generation, if ``expected`` is selected now and no active chunk lacks a vector."""
        state = self.ledger.head()
        if generation not in self._profiles(state):
            raise Refused("NOT_PREPARED")
        if state.get("active_generation") != expected:
            raise Refused("ACTIVE_CONFLICT")
        _refuse(self.missing(generation, active), "COVERAGE_INCOMPLETE", "chunk_id")
        if expected == generation:
            return state["generation"]
        return self.ledger._commit(state, "ACTIVATE", f"activate-{uuid.uuid4().hex} {generation}", "", active_generation=generation)
