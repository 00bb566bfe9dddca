"""Queries on passages, vectors and dialogues: retrieval, contexts, grouping by vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouping, retrieval
from ..session import cut
from ..sources import tables
from .registry import query, table
from .texts import WORDS_SQL, articles

BM25_SQL = f"""
doc_words AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
lengths AS (SELECT doc_id, len(words) AS length FROM doc_words),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM doc_words) GROUP BY 1, 2),
spread AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
asked AS (
  SELECT item_id AS question_id, term, count(*) AS times
  FROM (SELECT item_id, unnest({WORDS_SQL}) AS term FROM benchmark) GROUP BY 1, 2),
facts AS (SELECT count(*) AS docs, avg(length) AS mean FROM lengths),
scores AS (
  SELECT a.question_id, tf.doc_id,
         round(sum(a.times * ln(1 + (docs - s.n + 0.5) / (s.n + 0.5))
           * tf.tf * 2.2 / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * l.length / mean))), 6) AS score
  FROM asked a JOIN tf ON tf.term = a.term JOIN spread s ON s.term = a.term
       JOIN lengths l ON l.doc_id = tf.doc_id, facts
  GROUP BY 1, 2),
hits AS (
  SELECT question_id, doc_id, score, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores)
  WHERE rank <= 5)"""

COSINE = """round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6)"""

CENTROID_SQL = """
parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM parts GROUP BY 1, 2),
centroids AS (SELECT CAST(label AS BIGINT) AS event_id, list(x ORDER BY pos) AS v FROM means GROUP BY 1),
vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def questions(spark, folder):
    return spark.read.parquet(table(folder, "benchmark")).select(F.col("item_id").alias("id"), "text")


def passages(spark, folder):
    return articles(spark, folder).select(F.col("doc_id").alias("id"), "text")


def vectors(spark, folder):
    return tables.read_vectors(spark, table(folder, "embeddings"))


@query("bm25_passages", f"WITH {BM25_SQL} SELECT * FROM hits")
def bm25_passages(spark, folder):
    return retrieval.bm25_topk(questions(spark, folder), passages(spark, folder), 5)


@query("question_context", f"""
WITH {BM25_SQL},
sized AS (
  SELECT h.question_id, h.rank, d.text, length(d.text) AS n,
         sum(length(d.text)) OVER (PARTITION BY h.question_id ORDER BY h.rank) AS running
  FROM hits h JOIN documents d ON d.doc_id = h.doc_id)
SELECT q.item_id AS question_id, count(s.rank) AS passages, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_chars,
       coalesce(string_agg(text, chr(10) || chr(10) ORDER BY rank), '') AS context
FROM (SELECT DISTINCT item_id FROM benchmark) q LEFT JOIN (SELECT * FROM sized WHERE running <= 8000) s ON s.question_id = q.item_id
GROUP BY q.item_id""")
def question_context(spark, folder):
    hits = cut(retrieval.bm25_topk(questions(spark, folder), passages(spark, folder), 5))
    return retrieval.build_context(hits, passages(spark, folder), 8000, questions(spark, folder))


@query("vector_neighbours", f"""
WITH vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS item_id, {COSINE} AS similarity
  FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id)
SELECT query_id, item_id, similarity, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS INTEGER) AS rank FROM pairs)
WHERE rank <= 5""")
def vector_neighbours(spark, folder):
    rows = vectors(spark, folder).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.vector_topk(rows, rows, 5, skip_self=True)


@query("vector_neighbours_by_cells", f"""
WITH vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS item_id, {COSINE} AS similarity
  FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id)
SELECT query_id, item_id, similarity, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS INTEGER) AS rank FROM pairs)
WHERE rank <= 5""")
def vector_neighbours_by_cells(spark, folder):
    """The route for two large sides, whatever the size of the table."""
    rows = vectors(spark, folder).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.vector_topk(rows, rows, 5, skip_self=True, bound=0)


@query("assigned_events", f"""
WITH {CENTROID_SQL},
best AS (
  SELECT a.vec_id, a.v, b.event_id, {COSINE} AS similarity FROM vecs a, centroids b
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.event_id) = 1)
SELECT vec_id, CASE WHEN similarity >= 0.25 THEN event_id ELSE min(vec_id) OVER (PARTITION BY v) + 1099511627776 END AS event_id,
       similarity, similarity < 0.25 AS opened FROM best""")
def assigned_events(spark, folder):
    rows = vectors(spark, folder)
    centroids = cut(grouping.centroids_of(rows, "label", "embedding"))
    return grouping.assign_events(rows, "vec_id", "embedding", centroids, 0.25)


@query("vector_groups")
def vector_groups(spark, folder):
    return grouping.group_vectors(vectors(spark, folder), "vec_id", "embedding", 10)[0]


@query("vector_groups_checked", "SELECT vec_id, true AS grouped FROM embeddings")
def vector_groups_checked(spark, folder):
    """What is fixed about the groups: every vector is in one of the ten."""
    groups = grouping.group_vectors(vectors(spark, folder), "vec_id", "embedding", 10)[0]
    return groups.select("vec_id", F.col("event_id").between(0, 9).alias("grouped"))


@query("question_answer_pairs", """
SELECT conv_id, turn AS question_turn, text AS question, next_turn AS answer_turn, next_text AS answer
FROM (SELECT *, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn, lead(text) OVER w AS next_text
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant'""")
def question_answer_pairs(spark, folder):
    return retrieval.qa_pairs(tables.read_dialogues(spark, table(folder, "conversations")))
