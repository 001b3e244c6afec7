"""Incremental ingestion: each micro-batch computes only what no earlier batch has computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.text import checksum
from graphloom.operators.lifecycle import to_compute


def ingest(stream: DataFrame, path: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Append ``compute`` of the new texts (by checksum) of each micro-batch of ``stream`` (text) to the table at ``path``.

    A batch that is replayed after a failure finds its checksums there and writes nothing twice.
    """

    def batch(rows: DataFrame, _: int) -> None:
        spark: SparkSession = rows.sparkSession
        keyed = rows.withColumn("checksum", checksum(F.col("text"))).dropDuplicates(["checksum"])
        try:
            known = spark.read.parquet(path)
        except Exception as missing:  # noqa: BLE001  the first batch finds no table
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            known = None
        if known is not None:
            keyed = keyed.join(to_compute(keyed, known, ["checksum"]), "checksum", "left_semi")
        compute(keyed).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
