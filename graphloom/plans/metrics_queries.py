"""Operational metrics and request limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.plans.registry import query
from graphloom.sources.tables import load
from graphloom.streaming import limiter

#: Upper bounds of the histogram's cumulative buckets.
BUCKETS = (10, 25, 50, 100, 250)


@query(f"SELECT event_type AS route, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, {', '.join(f'count(*) FILTER (value <= {b}) AS le_{b}' for b in BUCKETS)}, count(*) FILTER (value > {BUCKETS[-1]}) AS overflow FROM events GROUP BY 1")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("route")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 4).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"),
        *[F.count_if(v <= b).alias(f"le_{b}") for b in BUCKETS], F.count_if(v > BUCKETS[-1]).alias("overflow"),
    )


@query("""WITH f AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY 1), r AS (SELECT user_id, row_number() OVER (ORDER BY first) AS n FROM f)
SELECT CASE WHEN n <= 50 THEN e.user_id::VARCHAR ELSE '<overflow>' END AS label, count(*) AS n FROM events e JOIN r USING (user_id) GROUP BY 1""")
def bounded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by principal; labels that arrive after the first fifty share one."""
    e = load(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    kept = first.orderBy("first").limit(50).select(F.col("user_id").alias("k_id"))
    label = F.when(F.col("k_id").isNotNull(), F.col("user_id").cast("string")).otherwise("<overflow>")
    return e.join(F.broadcast(kept), F.col("user_id") == F.col("k_id"), "left").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n, round(avg(toxic), 6) AS toxic_rate, round(avg(quality), 6) AS quality_rate FROM labels JOIN documents USING (doc_id) GROUP BY source")
def review_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reviewers found in each source."""
    return load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("toxic"), 6).alias("toxic_rate"), F.round(F.avg("quality"), 6).alias("quality_rate")
    )


@query("""WITH a AS (SELECT d.doc_id, d.n_chars > 200 AS accepted, l.quality = 1 AS correct FROM documents d JOIN labels l USING (doc_id))
SELECT count(*) AS items, count(*) FILTER (accepted) AS accepted, round(count(*) FILTER (accepted AND correct) / count(*) FILTER (accepted), 6) AS "precision", round(count(*) FILTER (accepted = correct) / count(*), 6) AS accuracy FROM a""")
def review_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and accuracy of a length rule against the adjudicated labels."""
    a = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").select(
        (F.col("n_chars") > 200).alias("accepted"), (F.col("quality") == 1).alias("correct")
    )
    n, acc = F.count(F.lit(1)), F.count_if("accepted")
    return a.agg(
        n.alias("items"), acc.alias("accepted"), F.round(F.count_if(F.col("accepted") & F.col("correct")) / acc, 6).alias("precision"),
        F.round(F.count_if(F.col("accepted") == F.col("correct")) / n, 6).alias("accuracy"),
    )


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).select(
        "user_id", "event_id", (F.col("us") / 1e6).alias("at")
    )


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
w AS (SELECT user_id, event_id, p, us AS start, 1 AS used, true AS admitted FROM e WHERE p = 1
  UNION ALL SELECT e.user_id, e.event_id, e.p, CASE WHEN e.us - w.start >= 43200000000 THEN e.us ELSE w.start END,
    CASE WHEN e.us - w.start >= 43200000000 THEN 1 WHEN w.used < 2 THEN w.used + 1 ELSE w.used END, e.us - w.start >= 43200000000 OR w.used < 2
  FROM w JOIN e ON e.user_id = w.user_id AND e.p = w.p + 1)
SELECT user_id, event_id, admitted FROM w""")
def rate_limit_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests in twelve hours, from the principal's own first request on."""
    return limiter.limit(_requests(spark, sf_dir), limiter.fixed_window(2, 43_200)).select("user_id", "event_id", "admitted")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts)::DOUBLE / 1e6 AS seconds, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
w AS (SELECT user_id, event_id, p, seconds, 2::DOUBLE AS tokens, true AS admitted FROM e WHERE p = 1
  UNION ALL SELECT user_id, event_id, p, seconds, CASE WHEN level + 1e-12 >= 1 THEN level - 1 ELSE level END, level + 1e-12 >= 1
  FROM (SELECT e.*, least(3::DOUBLE, w.tokens + (e.seconds - w.seconds) * 4::DOUBLE / 86400::DOUBLE) AS level FROM w JOIN e ON e.user_id = w.user_id AND e.p = w.p + 1))
SELECT user_id, event_id, admitted FROM w""")
def rate_limit_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four requests a day, three at once."""
    return limiter.limit(_requests(spark, sf_dir), limiter.token_bucket(4, 86_400, 3)).select("user_id", "event_id", "admitted")


@query("""WITH d AS (SELECT user_id, event_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR AS starts FROM events),
s AS (SELECT user_id, ts, sum(coalesce(starts, true)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM d)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY 1, 2""")
def request_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A principal's requests cut where it was silent for over twelve hours."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events").withColumn("gap", F.col("ts") - F.lag("ts").over(order) > F.expr("interval 12 hours"))
    numbered = e.withColumn("session", F.sum(F.coalesce("gap", F.lit(True)).cast("int")).over(order))
    return numbered.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
