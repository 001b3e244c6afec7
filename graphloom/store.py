"""Small files in the shared folder that appear whole and once: what commits, pointers and versioned tables rest on."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def local_path(path: str) -> str | None:
    """The path on this machine's file system, if it is one there."""
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def publish_new(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file ``path`` with this text, whole and at once, unless there is one: of several writers exactly one succeeds."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    local = local_path(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local_path(beside), "x", encoding="utf-8", newline="") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(local_path(beside), local)  # fails if the name is taken
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(local_path(beside))
    jvm = spark.sparkContext._jvm
    fs, written = _files(spark, beside)
    out = fs.create(written, True)
    out.write(bytearray(text.encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(path)
    try:
        if not fs.exists(target) and fs.rename(written, target):
            return read_text(spark, path) == text
        return False
    finally:
        fs.delete(written, False)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    fs, target = _files(spark, path)
    if not fs.exists(target):
        return None
    jvm = spark.sparkContext._jvm
    stream = fs.open(target)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    fs, target = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def move(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder a new name; into another file system it is copied."""
    fs, source = _files(spark, path)
    other, target = _files(spark, to)
    other.mkdirs(target.getParent())
    if fs.getUri() != other.getUri() or not fs.rename(source, target):
        jvm = spark.sparkContext._jvm
        if not jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, other, target, True, spark.sparkContext._jsc.hadoopConfiguration()):
            raise OSError(f"{path} was not moved to {to}")


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _files(spark, path)
    fs.delete(target, True)


def table_version(rows: DataFrame) -> str:
    """A name for the state of a stored table: its files, their sizes and times. Any file written or removed gives another."""
    seen = rows.select(*[F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_modification_time")]).distinct()
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "file_path", "file_size", "file_modification_time"))
    found = seen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(mark(0), F.lit(0)).alias("a"), F.coalesce(mark(1), F.lit(0)).alias("b")).first()
    return f"{found['n']}-{found['a'] & (1 << 64) - 1:016x}{found['b'] & (1 << 64) - 1:016x}"
