"""What the operators share: reading tables, staging tables in the shared folder, word splitting."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.staging import release, shared_root, stage, staging_path  # noqa: F401  the operators take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, by a path that only Spark needs to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: dict = {}


def held(key: tuple, make: Callable):
    """A value that stays with this Python worker, which Spark reuses, until a task that doesn't keep it trims."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def trim(keep: tuple | None = None) -> None:
    """Drop what earlier tasks of this Python worker hold, but ``keep``, and give back to the system what they have freed."""
    for key in [k for k in _held if k != keep]:
        del _held[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give_back:
        give_back(0)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for internal columns that no column of ``df`` has (Spark compares them without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc32_of_id(doc_id: str = "doc_id"):
    """crc32 of the id as text: what the folds of the contracts are dealt by."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def byte_lengths(texts: pa.Array) -> np.ndarray:
    """UTF-8 length of each text, 0 for null."""
    return np.asarray(pc.fill_null(pc.binary_length(texts), 0))


def chunks_by_bytes(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive rows of at most ``most`` bytes each; a longer row is a slice of its own."""
    start, total = 0, 0
    for row, n in enumerate(lengths.tolist()):
        if row > start and total + n > most:
            yield slice(start, row)
            start, total = row, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


#: Words of more bytes are not kept in memos, so that a memo's bytes are bounded as its words are.
LONG_WORD = 64


class HashMemo(dict):
    """64-bit hashes of words (bytes), each computed once; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def white_words(text: str | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


_ALNUM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_ALNUM).split() if text else []


def lazily(make: Callable):
    """A holder whose value is made once in each Python worker, on first use."""
    cell: list = []

    def get():
        if not cell:
            cell.append(make())
        return cell[0]

    return get
