"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import access, chunking, fulltext, retrieval
from graphloom.operators.retrieval import Limits
from graphloom.plans.registry import query
from graphloom.sources.derived import MENTIONS_SQL, VERSIONS_SQL, document_versions, mentions
from graphloom.sources.tables import load
from graphloom.staging import stage

#: The fixed query: a vector that rises and falls, and three words.
QUERY_VECTOR = [round(((i * 7) % 13 - 6) / 6, 4) for i in range(64)]
TERMS = ["the", "thand", "of"]

_VECTOR = "[" + ",".join(str(x) for x in QUERY_VECTOR) + "]::DOUBLE[]"
VECTOR_SQL = f"""v AS (
  SELECT vec_id AS id, round((1 + list_dot_product(embedding::DOUBLE[], {_VECTOR}) /
     (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_VECTOR}, {_VECTOR})))) / 2, 6) AS score
  FROM embeddings),
vr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM v WHERE score IS NOT NULL QUALIFY rank <= 20)"""
_TF = ", ".join(f"len(list_filter(bag, lambda w: w = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
_SCORE = " + ".join(
    f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(TERMS))
)
BM25_SQL = f"""bags AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS bag FROM documents),
tf AS (SELECT id, len(bag) AS length, {_TF} FROM bags),
st AS (SELECT count(*) AS n, avg(length) AS mean, {", ".join(f"count_if(tf{i} > 0) AS df{i}" for i in range(len(TERMS)))} FROM tf),
b AS (SELECT id, round({_SCORE}, 6) AS score FROM tf, st WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(TERMS)))}),
br AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM b QUALIFY rank <= 20)"""
RRF_SQL = """f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS channels
      FROM (SELECT id, rank FROM vr UNION ALL SELECT id, rank FROM br) GROUP BY id)"""
EXPAND_SQL = """se AS (SELECT m.chunk_id AS seed, m.entity_id, row_number() OVER (PARTITION BY m.chunk_id ORDER BY m.confidence DESC, m.entity_id) AS n
        FROM mentions m JOIN seeds ON m.chunk_id = seeds.id QUALIFY n <= 20),
deg AS (SELECT entity_id, count(DISTINCT chunk_id) AS degree FROM mentions GROUP BY 1),
sc AS (SELECT se.seed, m.chunk_id AS candidate, round(sum(1.0::DOUBLE / degree), 6) AS score
       FROM se JOIN mentions m ON m.entity_id = se.entity_id AND m.chunk_id <> se.seed JOIN deg ON deg.entity_id = se.entity_id GROUP BY 1, 2),
ex AS (SELECT seed, candidate, score, row_number() OVER (PARTITION BY seed ORDER BY score DESC, candidate)::INT AS rank FROM sc QUALIFY rank <= 20)"""


def _vector(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return retrieval.top_k(retrieval.vector_scores(load(spark, sf_dir, "embeddings"), QUERY_VECTOR), k)


def _bm25(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return retrieval.top_k(_word_scores(spark, sf_dir), k)


def _word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.bm25(fulltext.index_of(load(spark, sf_dir, "documents"), f"{sf_dir}/documents"), TERMS)


@query(f"WITH {VECTOR_SQL} SELECT id, score, rank FROM vr")
def vector_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector(spark, sf_dir)


@query(f"WITH {BM25_SQL} SELECT id, score, rank FROM br")
def bm25_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir)


@query(f"WITH {VECTOR_SQL}, {BM25_SQL}, {RRF_SQL} SELECT id, score, channels FROM f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rrf({"vector": _vector(spark, sf_dir), "bm25": _bm25(spark, sf_dir)})


@query(f"WITH {VECTOR_SQL}, {BM25_SQL}, {RRF_SQL} SELECT id, score, channels FROM f WHERE channels >= 2".replace("rank <= 20", "rank <= 200"))
def rrf_channel_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two hundred hits a channel, those that both channels have."""
    return retrieval.rrf({"vector": _vector(spark, sf_dir, 200), "bm25": _bm25(spark, sf_dir, 200)}).filter("channels >= 2")


@query("SELECT l_partkey AS entity_id, count(DISTINCT l_orderkey) AS degree FROM lineitem GROUP BY 1")
def entity_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.entity_degrees(mentions(spark, sf_dir))


@query(f"WITH {MENTIONS_SQL}, seeds AS (SELECT DISTINCT chunk_id AS id FROM mentions ORDER BY 1 LIMIT 20), {EXPAND_SQL} SELECT seed, candidate, score, rank FROM ex")
def graph_expansion_ra(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    return retrieval.expand(m, limits=Limits(edges_per_seed=0), seeds=m.select(F.col("chunk_id").alias("id")).distinct().orderBy("id").limit(20))


@query(f"""WITH {VECTOR_SQL}, {BM25_SQL}, {RRF_SQL}, {MENTIONS_SQL},
seeds AS (SELECT id FROM f ORDER BY score DESC, id LIMIT 5), {EXPAND_SQL},
m AS (SELECT id FROM f UNION SELECT candidate AS id FROM ex WHERE candidate IN (SELECT doc_id FROM documents)),
rv AS (SELECT id, row_number() OVER (ORDER BY v.score DESC, id)::INT AS rank FROM v JOIN m USING (id)),
fin AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS channels
        FROM (SELECT id, rank FROM rv UNION ALL SELECT id, rank FROM br) GROUP BY id)
SELECT id, score, channels, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM fin QUALIFY rank <= 5""")
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: recall by vectors and words, fusion, expansion from the best, re-score of all candidates, fusion."""
    limits = Limits(edges_per_seed=0)
    docs, vectors = load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings")
    scored = retrieval.vector_scores(vectors, QUERY_VECTOR)
    by_words = stage(_bm25(spark, sf_dir, limits.recall_k), "by-words")
    fused = stage(retrieval.rrf({"vector": retrieval.top_k(scored, limits.recall_k), "bm25": by_words}, limits.rrf_k), "fused")
    seeds = fused.orderBy(F.desc("score"), "id").limit(limits.seeds)
    near = retrieval.expand(mentions(spark, sf_dir), seeds, limits).select(F.col("candidate").alias("id"))
    known = near.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    merged = fused.select("id").unionByName(known).distinct()
    again = scored.join(merged, "id", "left_semi")
    # At most the fused ids and each seed's candidates.
    most = 2 * limits.recall_k + limits.seeds * limits.per_seed
    final = retrieval.rrf({"vector": retrieval.top_k(again, most), "bm25": by_words}, limits.rrf_k)
    return retrieval.top_k(final, limits.top_k)


@query(f"WITH {VECTOR_SQL}, m AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_partkey <= 20) SELECT v.id, v.score, row_number() OVER (ORDER BY v.score DESC, v.id)::INT AS rank FROM v JOIN m USING (id) QUALIFY rank <= 100")
def candidate_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine over a merged candidate set (here: orders of the first parts)."""
    wanted = load(spark, sf_dir, "lineitem").filter("l_partkey <= 20").select(F.col("l_orderkey").alias("id")).distinct()
    scored = retrieval.vector_scores(load(spark, sf_dir, "embeddings"), QUERY_VECTOR)
    return retrieval.top_k(scored.join(wanted, "id", "left_semi"), 100)


@query("""WITH c AS (SELECT doc_id, unnest(range(0, ((length(text) - 1) // 1200 + 1)::BIGINT)) AS o, length(text) AS n FROM documents WHERE length(text) > 0),
a AS (SELECT doc_id, max(o) // 2 AS anchor FROM c GROUP BY 1)
SELECT c.doc_id, c.o::INT AS ordinal, a.anchor::INT AS anchor, (c.o - a.anchor)::INT AS distance FROM c JOIN a USING (doc_id) WHERE abs(c.o - a.anchor) BETWEEN 1 AND 1""")
def adjacent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each document's middle chunk."""
    chunks = chunking.split_fixed(load(spark, sf_dir, "documents")).select("doc_id", "ordinal")
    anchors = chunks.groupBy("doc_id").agg(F.floor(F.max("ordinal") / 2).cast("int").alias("ordinal"))
    return retrieval.adjacent(chunks, anchors, 1)


@query("SELECT doc_id, lang, sha256(text) AS checksum FROM documents QUALIFY row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY n_chars DESC, doc_id) = 1")
def stable_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))
    return retrieval.first_of_each(d, ["lang", "checksum"], [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "lang", "checksum")


@query("""WITH RECURSIVE r AS (SELECT source, doc_id AS id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents),
g AS (SELECT source, 0::BIGINT AS p, 0::BIGINT AS taken, 0::BIGINT AS used, NULL::BIGINT AS id, 0::BIGINT AS size, false AS fits FROM (SELECT DISTINCT source FROM r)
  UNION ALL
  SELECT r.source, r.p, g.taken + CASE WHEN g.taken < 5 AND g.used + r.size <= 12000 THEN 1 ELSE 0 END,
         g.used + CASE WHEN g.taken < 5 AND g.used + r.size <= 12000 THEN r.size ELSE 0 END, r.id, r.size, g.taken < 5 AND g.used + r.size <= 12000
  FROM g JOIN r ON r.source = g.source AND r.p = g.p + 1)
SELECT source, id, size, p AS position FROM g WHERE fits""")
def context_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy context for each source: five documents and 12,000 characters at most."""
    by = Window.partitionBy("source").orderBy("doc_id")
    d = load(spark, sf_dir, "documents").select(
        "source", F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.row_number().over(by).cast("long").alias("position")
    )
    return retrieval.select_context(d, 5, 12_000, "source")


@query("""SELECT doc_id, CASE WHEN strpos(lower(text), 'est') > 0
  THEN substring(text, greatest(0, least(strpos(lower(text), 'est') - 1 - 58, length(text) - 120)) + 1, 120) ELSE substring(text, 1, 120) END AS excerpt FROM documents""")
def source_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", retrieval.source_window(F.col("text"), "est", 120).alias("excerpt"))


@query(f"""WITH {VECTOR_SQL}, {BM25_SQL}, {RRF_SQL}
SELECT 'vector' AS stage, id, score, rank FROM vr UNION ALL SELECT 'bm25', id, score, rank FROM br
UNION ALL SELECT 'fusion', id, score, row_number() OVER (ORDER BY score DESC, id)::INT FROM f""")
def retrieval_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's hits in long form."""
    vector, words = stage(_vector(spark, sf_dir), "by-vector"), stage(_bm25(spark, sf_dir), "by-words")
    both = retrieval.rrf({"vector": vector, "bm25": words})
    stages = {"vector": vector, "bm25": words, "fusion": retrieval.top_k(both, 2 * Limits().recall_k)}
    out = None
    for name, hits in stages.items():
        one = hits.select(F.lit(name).alias("stage"), "id", "score", "rank")
        out = one if out is None else out.unionByName(one)
    return out


#: Who asks: a member of four groups, who reads what was published by noon.
READER, UNTIL = access.Principal("t0", ("src1", "src3", "src4", "src5")), "2024-01-01 12:00:00"
AUTHORIZED_SQL = f"""{VERSIONS_SQL}, {MENTIONS_SQL},
scope AS (SELECT document_id AS id FROM versions WHERE tenant_id = 't0' AND list_has_any(access_groups, ['src1', 'src3', 'src4', 'src5'])
          AND coalesce(lifecycle, 'ACTIVE') = 'ACTIVE' AND published_at <= TIMESTAMP '{UNTIL}'),
{VECTOR_SQL.split("vr AS")[0]} {BM25_SQL.split("br AS")[0]}
vr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM v JOIN scope USING (id) WHERE score >= 0 QUALIFY rank <= 20),
scan AS (SELECT id, score FROM b WHERE score >= 0 ORDER BY score DESC, id LIMIT 100),
br AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM scan JOIN scope USING (id) QUALIFY rank <= 20),
{RRF_SQL},
seeds AS (SELECT id, row_number() OVER (ORDER BY score DESC, id)::INT AS seed_rank FROM f QUALIFY seed_rank <= 5),
readable AS (SELECT m.* FROM mentions m JOIN scope ON m.chunk_id = scope.id),
se AS (SELECT m.chunk_id AS seed, m.entity_id, row_number() OVER (PARTITION BY m.chunk_id ORDER BY m.confidence DESC, m.entity_id) AS n
       FROM readable m JOIN seeds ON m.chunk_id = seeds.id QUALIFY n <= 20),
deg AS (SELECT entity_id, count(DISTINCT chunk_id) AS degree FROM readable GROUP BY 1),
edges AS (SELECT se.seed, m.chunk_id AS candidate, degree, row_number() OVER (PARTITION BY se.seed ORDER BY m.chunk_id, se.entity_id) AS n
          FROM se JOIN readable m ON m.entity_id = se.entity_id AND m.chunk_id <> se.seed JOIN deg ON deg.entity_id = se.entity_id QUALIFY n <= 100),
sc AS (SELECT seed, candidate, round(sum(1.0::DOUBLE / degree), 6) AS score FROM edges GROUP BY 1, 2),
ex AS (SELECT seed, candidate, score, row_number() OVER (PARTITION BY seed ORDER BY score DESC, candidate)::INT AS rank FROM sc QUALIFY rank <= 20),
listed AS (SELECT id, 0 AS channel, rank AS pos FROM vr UNION ALL SELECT id, 1, rank FROM br
           UNION ALL SELECT candidate, 2, seed_rank * 21 + rank FROM ex JOIN seeds ON ex.seed = seeds.id),
firsts AS (SELECT id, channel, pos FROM listed QUALIFY row_number() OVER (PARTITION BY id ORDER BY channel, pos) = 1),
merged AS (SELECT id, row_number() OVER (ORDER BY channel, pos)::INT AS place FROM firsts QUALIFY place <= 100),
rv AS (SELECT id, row_number() OVER (ORDER BY v.score DESC, id)::INT AS rank FROM v JOIN merged USING (id) JOIN scope USING (id) WHERE v.score >= 0),
fin AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS channels
        FROM (SELECT id, rank FROM rv UNION ALL SELECT id, rank FROM br) GROUP BY id),
ranked AS (SELECT id, score, channels, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM fin)"""


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    readable = access.active(access.authorized(document_versions(spark, sf_dir), READER))
    return access.in_versions(readable, published_until=UNTIL).select(F.col("document_id").alias("id"))


def _authorized(spark: SparkSession, sf_dir: str) -> retrieval.Retrieved:
    vectors = retrieval.vector_scores(load(spark, sf_dir, "embeddings"), QUERY_VECTOR)
    return retrieval.retrieve(vectors, _word_scores(spark, sf_dir), mentions(spark, sf_dir), _scope(spark, sf_dir))


@query(f"WITH {AUTHORIZED_SQL} SELECT id, score, channels, rank FROM ranked")
def retrieval_authorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole retrieval for one reader: tenant, groups, lifecycle and publication time hold in every channel."""
    return _authorized(spark, sf_dir).ranked


@query(f"WITH {AUTHORIZED_SQL} SELECT id, place FROM merged")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates in order: by vectors, by words, by the graph; the first occurrence counts."""
    return _authorized(spark, sf_dir).merged


@query(f"""WITH RECURSIVE {AUTHORIZED_SQL},
chunks AS (SELECT doc_id AS id, source AS document_id, doc_id // 20 AS ordinal, length(text) AS size, sha256(text) AS content FROM documents JOIN scope ON doc_id = scope.id),
anchors AS (SELECT rank AS anchor, id AS a_id, document_id, ordinal AS a_ordinal FROM ranked JOIN chunks USING (id) WHERE rank <= 3),
beside AS (SELECT c.id, row_number() OVER (ORDER BY anchor, abs(ordinal - a_ordinal), ordinal, c.id) AS rank
           FROM chunks c JOIN anchors a ON a.document_id = c.document_id AND abs(ordinal - a_ordinal) <= 1 AND c.id <> a_id QUALIFY rank <= 6),
first AS (SELECT id, part, rank FROM (SELECT id, 0 AS part, rank FROM ranked UNION ALL SELECT id, 1, rank FROM beside)
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY part, rank) = 1),
known AS (SELECT id, part, rank, size, row_number() OVER (PARTITION BY content ORDER BY part, rank) AS nth FROM first JOIN chunks USING (id)),
kept AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY rank) AS place FROM known WHERE nth = 1),
roles AS (SELECT id, size, place, CASE WHEN part = 1 THEN 'adjacent' WHEN place <= 3 THEN 'anchor' ELSE 'ranked' END AS role FROM kept),
queue AS (SELECT id, role, size, row_number() OVER (ORDER BY CASE role WHEN 'anchor' THEN 0 WHEN 'adjacent' THEN 1 ELSE 2 END, place) AS position FROM roles),
walk AS (SELECT 0::BIGINT AS position, NULL::BIGINT AS id, NULL::VARCHAR AS role, NULL::BIGINT AS size, NULL::VARCHAR AS decision, 0::BIGINT AS taken, 0::BIGINT AS used
  UNION ALL SELECT q.position, q.id, q.role, q.size, q.decision, w.taken + (q.decision = 'selected')::BIGINT, w.used + CASE WHEN q.decision = 'selected' THEN q.size ELSE 0 END
  FROM walk w, LATERAL (SELECT position, id, role, size, CASE WHEN w.taken >= 5 THEN 'chunk_limit' WHEN size = 0 THEN 'missing_or_empty'
    WHEN w.used + size > 12000 THEN 'character_budget' ELSE 'selected' END AS decision FROM queue WHERE position = w.position + 1) q)
SELECT position::INT AS position, id, role, size, decision FROM walk WHERE position > 0
UNION ALL SELECT NULL, id, NULL, NULL, 'duplicate_content' FROM known WHERE nth > 1""")
def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the ranking and its neighbours makes the context, and why the rest does not; chunks of a source are neighbours."""
    docs = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("document_id"), F.floor(F.col("doc_id") / 20).alias("ordinal"),
        F.length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("content"),
    )
    return retrieval.context_of(_authorized(spark, sf_dir).ranked, docs, _scope(spark, sf_dir))
