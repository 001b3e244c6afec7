"""Tables written in the cluster's shared folder: they cut lineages and are computed once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []
_kept: dict[tuple, object] = {}
_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where it is unset, a folder of our own on a local master alone."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="graphloom-")
    return f"file://{_own_root}"


def staging_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; removed by ``release`` or when the driver ends."""
    path = f"{shared_root(spark)}/graphloom-{label}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


#: Shuffle files of a query go when it has ended, not when the driver happens to collect its garbage; tables are packed tighter.
_SPARING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


@contextmanager
def sparing(spark: SparkSession) -> Iterator[None]:
    """What is executed inside takes little disk and leaves no shuffle files, for queries that each run once."""
    before = {key: spark.conf.get(key, None) for key in _SPARING}
    for key, value in _SPARING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks that it ran, and what is read
    more than once is computed once.
    """
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def many(rows: DataFrame) -> DataFrame:
    """``rows`` for joins that shuffle them. Spark judges stored rows by their files; small files of much alike rows would be sent to the driver and from there to all."""
    return rows.hint("merge")


def kept(key: tuple, make):
    """A staged table (or several) that several queries read, made once for ``key`` and until ``release``. The key must name the state of what it is made of."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended: the cluster's clean-up takes the folder
        pass


def staged_path(rows: DataFrame) -> str | None:
    """Where a table that ``stage`` has given lies; None for others and for empty ones."""
    folders = {file.rsplit("/", 2)[-2] for file in rows.inputFiles()}
    return next((path for _, path in _staged if path.rsplit("/", 1)[-1] in folders), None)


def drop(rows: DataFrame) -> None:
    """Delete a table that ``stage`` has given, when nothing will read it any more."""
    path = staged_path(rows)
    for entry in [e for e in _staged if e[1] == path]:
        _staged.remove(entry)
        _delete(*entry)


def release() -> None:
    """Delete all staged tables. Call it only when the results that read them are written."""
    _kept.clear()
    while _staged:
        _delete(*_staged.pop())


def _leave() -> None:
    release()
    if _own_root:
        shutil.rmtree(_own_root, ignore_errors=True)


atexit.register(_leave)
