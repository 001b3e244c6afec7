"""Revisions, publications and their differences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current(revisions: DataFrame) -> DataFrame:
    """The last revision of each record."""
    last = F.max_by(F.struct(*revisions.columns), "revision")
    return revisions.groupBy("record_id").agg(last.alias("r")).select("r.*")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(record_id, old_revision, new_revision, change) of two manifests (record_id, revision)."""
    a = old.select(F.col("record_id").alias("a_id"), F.col("revision").alias("old_revision"))
    b = new.select(F.col("record_id").alias("b_id"), F.col("revision").alias("new_revision"))
    change = (
        F.when(F.col("a_id").isNull(), "ADDED").when(F.col("b_id").isNull(), "REMOVED")
        .when(F.col("old_revision") == F.col("new_revision"), "UNCHANGED").otherwise("CHANGED")
    )
    return a.join(b, F.col("a_id") == F.col("b_id"), "full").select(
        F.coalesce("a_id", "b_id").alias("record_id"), "old_revision", "new_revision", change.alias("change")
    )


def publish(active: DataFrame, removed: DataFrame, replaced: DataFrame, new: DataFrame) -> DataFrame:
    """The next manifest: active without removed and replaced records, with the new ones (record_id, revision)."""
    gone = removed.select("record_id").unionByName(replaced.select("record_id")).distinct()
    return active.join(gone, "record_id", "left_anti").unionByName(new)


def collisions(active: DataFrame, removed: DataFrame, replaced: DataFrame, new: DataFrame) -> DataFrame:
    """(record_id, code) of what a publication must refuse."""
    ids = lambda df: df.select("record_id").distinct()
    carried = ids(active).join(ids(removed), "record_id", "left_anti").join(ids(replaced), "record_id", "left_anti")
    clash = ids(new).join(carried, "record_id", "left_semi").withColumn("code", F.lit("COLLIDES_WITH_CARRIED"))
    gone = ids(new).join(ids(removed), "record_id", "left_semi").withColumn("code", F.lit("COLLIDES_WITH_REMOVED"))
    absent = ids(removed).unionByName(ids(replaced)).join(ids(active), "record_id", "left_anti").withColumn("code", F.lit("NOT_ACTIVE"))
    twice = new.groupBy("record_id").count().filter("count > 1").select("record_id", F.lit("DUPLICATE_RECORD").alias("code"))
    return clash.unionByName(gone).unionByName(absent).unionByName(twice).distinct()


def manifest_digest(members: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, members, digest): the SHA-256 of a group's values in order, with commas between them; hashed as they pass, never listed."""

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, state = None, 0, None
        for frame in frames:
            rows = []
            for key, text in zip(frame[group], frame[value], strict=True):
                if n == 0 or key != now:
                    if n:
                        rows.append((now, n, state.hexdigest()))
                    now, n, state = key, 0, hashlib.sha256()
                state.update(f"{',' if n else ''}{text}".encode())
                n += 1
            yield pd.DataFrame(rows, columns=[group, "members", "digest"])
        if n:
            yield pd.DataFrame([(now, n, state.hexdigest())], columns=[group, "members", "digest"])

    rows = members.select(group, order, value)
    return rows.repartition(group).sortWithinPartitions(group, order).mapInPandas(digest, f"{group} {dict(rows.dtypes)[group]}, members long, digest string")


def to_compute(inputs: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs without an artifact under their key, each key once: what an incremental run still has to do."""
    return inputs.select(*keys).distinct().join(artifacts.select(*keys).distinct(), keys, "left_anti")


def replay(again: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, problem, n): rows that mapping the sources again gives and the store lacks, and the other way round, repeated rows counted."""
    out = None
    for problem, rows in (("missing", again.exceptAll(stored)), ("unexpected", stored.exceptAll(again))):
        one = rows.groupBy(key).agg(F.lit(problem).alias("problem"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def save(store: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next store, outcomes) of writes (record_id, expected_revision, content) on a store (record_id, revision, content).

    A content that the last revision has already is a replay, which stores nothing and stands in no other write's way. Any other
    write holds if it expects the record's last revision (none for a new record); of such writes on one record, the one
    with the smallest content holds (null first). Outcomes: (record_id, expected_revision, content, outcome, revision). Repeated
    writes count once. Null contents equal one another; a null record_id belongs to no record and is refused.
    """
    last = current(store).select(F.col("record_id").alias("s_id"), F.col("revision").alias("s_revision"), F.col("content").alias("s_content"))
    met = writes.distinct().join(last, F.col("record_id") == F.col("s_id"), "left")
    replayed = F.col("s_id").isNotNull() & F.col("content").eqNullSafe(F.col("s_content"))
    fits = F.col("record_id").isNotNull() & ~replayed & F.col("expected_revision").eqNullSafe(F.col("s_revision"))
    first = F.row_number().over(Window.partitionBy("record_id", "fits").orderBy("content"))
    met = met.withColumn("fits", fits).withColumn("nth", first)
    outcome = F.when(replayed, "REPLAYED").when(F.col("fits") & (F.col("nth") == 1), "STORED").otherwise("REVISION_CONFLICT")
    revision = F.when(F.col("outcome") == "STORED", F.coalesce("s_revision", F.lit(0)) + 1).when(F.col("outcome") == "REPLAYED", F.col("s_revision"))
    done = met.withColumn("outcome", outcome).withColumn("revision", revision.cast("int"))
    new = done.filter("outcome = 'STORED'").select("record_id", "revision", "content")
    return store.select("record_id", "revision", "content").unionByName(new), done.select("record_id", "expected_revision", "content", "outcome", "revision")


def rollback(publications: DataFrame, target: str) -> DataFrame:
    """The manifest to publish next: the members of an earlier publication (publication_id, record_id, revision), as that one had them."""
    return publications.filter(F.col("publication_id") == target).select("record_id", "revision")
