"""Incremental ingestion and request limits as streams: the same rows as in one batch, once each, over restarts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.text import checksum
from graphloom.streaming import ingest, limiter


def test_ingest_computes_each_text_once_over_restarts(spark, tmp_path):
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("source", "out", "state"))
    compute = lambda rows: rows.select("checksum", F.length("text").alias("size"))
    batches = [["a", "bb", "a"], ["bb", "ccc", ""], [], ["a", "dddd"]]
    seen: set[str] = set()
    for texts in batches:
        spark.createDataFrame([(t,) for t in texts], "text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("text string").parquet(source)
        query = ingest.ingest(stream, out, state, compute)
        query.awaitTermination()
        assert query.exception() is None
        seen |= set(texts)
        rows = spark.read.parquet(out).collect()
        assert sorted(r["size"] for r in rows) == sorted(len(t) for t in seen)
        assert len({r["checksum"] for r in rows}) == len(rows)
    expected = spark.createDataFrame([(t,) for t in seen], "text string").select(checksum(F.col("text")).alias("c")).collect()
    assert {r["c"] for r in expected} == {r["checksum"] for r in rows}


def test_limits_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    requests = [(u, i, float(t)) for i, (u, t) in enumerate((u, t * 7 % 50 + t) for t in range(40) for u in (1, 2, 3) if t % u == 0)]
    requests.sort(key=lambda r: (r[2], r[1]))
    schema = "user_id long, event_id long, at double"
    for step in (limiter.fixed_window(3, 20), limiter.token_bucket(2, 15, 4)):
        want = {(r.user_id, r.event_id): r.admitted for r in limiter.limit(spark.createDataFrame(requests, schema), step).collect()}
        name = f"limits{id(step)}"
        source = f"file://{tmp_path}/{name}"
        for k in range(0, len(requests), 25):
            spark.createDataFrame(requests[k : k + 25], schema).coalesce(1).write.mode("append").parquet(source)
            stream = limiter.limit_stream(spark.readStream.schema(schema).parquet(source), step)
            query = stream.writeStream.format("parquet").option("path", f"{source}-out").option("checkpointLocation", f"{source}-state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
        got = {(r.user_id, r.event_id): r.admitted for r in spark.read.parquet(f"{source}-out").collect()}
        assert got == want and {True, False} == set(got.values())
