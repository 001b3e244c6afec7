"""Operator 2: token counts.

Arrow functions encode batches of texts and return lengths only. Each Arrow batch is cut into
sub-batches of about equal bytes; long texts are cut where no token can cross, and equal pieces
of texts are encoded once (``pieces.PieceEncoder``).

Defined results: a null or empty text has 0 bytes and 0 tokens. Special strings inside a text become
their special token, as is the library's default. Rows are neither joined nor shuffled, so repeated
rows and null ids stay as they are. The result has fixed columns, whatever else the table holds. An empty table gives no rows. A
very long text is a batch of its own, of which one task holds the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common
from graphloom.llm.pieces import worker_encoder

BATCH_BYTES = 4_000_000


def token_counts(
    docs: DataFrame, vocabulary: str, spaced: bool = True, id_column: str = "doc_id", text_column: str = "text",
    limit: int = 512, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row; ``spaced`` as in ``pieces.PieceEncoder``."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = worker_encoder(vocabulary, spaced)
        for texts in batches:
            sizes = common.byte_lengths(texts)
            out = [np.zeros(0, np.int64)]
            for part in common.chunks_by_bytes(sizes, batch_bytes):
                out.append(encoder.lengths([t or "" for t in texts[part.start : part.stop].to_pylist()]))
            yield pa.array(np.concatenate(out), pa.int64())

    text = F.col(text_column)
    return (
        docs.select(F.col(id_column), text)
        .select(
            F.col(id_column),
            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
            count(text).alias("n_tokens"),
        )
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
