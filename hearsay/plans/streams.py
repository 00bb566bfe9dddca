"""Streaming queries, run over all landed files and read back from their sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions.durations import bucket_start
from ..operators import grouping, sentiment
from ..session import fresh_path
from ..sources import sinks, tables
from ..streaming import assignment, bursts, live
from .activity import SERIES_SQL, POSTS_SQL, posts
from .answers import CENTROID_SQL, COSINE, vectors
from .registry import landing, query
from .texts import SCORED_SQL, TOXIC_SQL, bayes_sql, labelled_articles

NTZ = "timestamp_ntz"
DELAY = "2 hours"
CLOCK_SQL = "clock AS (SELECT max(ts) - INTERVAL '2 hours' AS closed_until FROM events)"


def live_posts(spark, folder):
    return tables.with_topic(live.stream_mentions(spark, landing(folder, "events"), schemas.ACTIVITY))


def timely(spark, folder):
    return live.with_lateness(live_posts(spark, folder), "ts", DELAY)


@query("live_posts", f"WITH {POSTS_SQL} SELECT event_id, ts, user_id, event_type, value, topic FROM posts")
def live_posts_landed(spark, folder):
    return spark.read.parquet(live.run_available(live_posts(spark, folder).drop("props")))


@query("live_first_copies", f"WITH {POSTS_SQL} SELECT DISTINCT topic FROM posts")
def live_first_copies(spark, folder):
    """Properties of a post stand for its text; all files land in one batch."""
    kept = live.drop_live_copies(timely(spark, folder), "props")
    return spark.read.parquet(live.run_available(kept)).select("topic")


@query("live_counts_tumbling", f"""
WITH {POSTS_SQL}, {CLOCK_SQL}
SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, topic, count(*) AS n, round(sum(value), 4) AS weight
FROM posts, clock WHERE topic IS NOT NULL AND time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= closed_until
GROUP BY 1, 2""")
def live_counts_tumbling(spark, folder):
    counts = live.live_counts(timely(spark, folder), "ts", "topic", "1 hour", weight="value")
    closed = spark.read.parquet(live.run_available(counts))
    return closed.select(
        F.col("window.start").cast(NTZ).alias("bucket"), "topic", "n", F.round("weight", 4).alias("weight")
    )


@query("live_counts_sliding", f"""
WITH {POSTS_SQL}, {CLOCK_SQL},
starts AS (
  SELECT *, unnest(generate_series(time_bucket(INTERVAL '2 hours', ts) - INTERVAL '4 hours',
                                   time_bucket(INTERVAL '2 hours', ts), INTERVAL '2 hours')) AS bucket
  FROM posts WHERE topic IS NOT NULL)
SELECT bucket, topic, count(*) AS n FROM starts, clock WHERE bucket + INTERVAL '6 hours' <= closed_until GROUP BY 1, 2""")
def live_counts_sliding(spark, folder):
    counts = live.live_counts(timely(spark, folder), "ts", "topic", "6 hours", "2 hours")
    closed = spark.read.parquet(live.run_available(counts))
    return closed.select(F.col("window.start").cast(NTZ).alias("bucket"), "topic", "n")


@query("live_episodes", f"""
WITH {POSTS_SQL}, {CLOCK_SQL},
marked AS (
  SELECT topic, ts,
         CASE WHEN ts <= lag(ts) OVER (PARTITION BY topic ORDER BY ts) + INTERVAL '12 hours' THEN 0 ELSE 1 END AS opens
  FROM posts WHERE topic IS NOT NULL),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY topic ORDER BY ts) AS episode FROM marked),
found AS (
  SELECT topic, min(ts) AS started_at, max(ts) + INTERVAL '12 hours' AS ended_at, count(*) AS n
  FROM numbered GROUP BY topic, episode)
SELECT found.* FROM found, clock WHERE ended_at <= closed_until""")
def live_episodes(spark, folder):
    found = live.live_episodes(timely(spark, folder), "ts", "topic", "12 hours")
    closed = spark.read.parquet(live.run_available(found))
    return closed.withColumns({c: F.col(c).cast(NTZ) for c in ("started_at", "ended_at")})


@query("live_hot_topics", f"""
WITH {POSTS_SQL}, {CLOCK_SQL},
counts AS (
  SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, topic, count(*) AS n FROM posts, clock
  WHERE topic IS NOT NULL AND time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' <= closed_until GROUP BY 1, 2)
SELECT bucket, topic, n, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY bucket ORDER BY n DESC, topic) AS INTEGER) AS rank FROM counts)
WHERE rank <= 5""")
def live_hot_topics(spark, folder):
    counts = live.live_counts(timely(spark, folder), "ts", "topic", "1 day")
    path = live.live_hot_topk(counts, 5, fresh_path(spark, "hot"))
    return spark.read.parquet(path).select(F.col("bucket").cast(NTZ).alias("bucket"), "topic", "n", "rank")


@query("live_bursts", f"""
WITH {SERIES_SQL}, {CLOCK_SQL},
scored AS (
  SELECT topic, bucket, n, avg(n) OVER w AS m, stddev_samp(n) OVER w AS sd, count(n) OVER w AS seen
  FROM series
  WINDOW w AS (PARTITION BY topic ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
z AS (SELECT topic, bucket, n, round((n - m) / greatest(sd, 1.0), 6) AS z FROM scored WHERE seen >= 3),
crossed AS (SELECT *, lag(z) OVER (PARTITION BY topic ORDER BY bucket) AS before FROM z)
SELECT topic, bucket, n, z FROM crossed, clock
WHERE z >= 3.0 AND coalesce(before, 0) < 3.0 AND bucket + INTERVAL '1 day' <= closed_until""")
def live_bursts(spark, folder):
    first = posts(spark, folder).agg(F.min("ts").alias("t")).select(
        F.unix_timestamp(bucket_start("t", "1 day").cast("timestamp"))
    ).first()[0]
    counts = live.live_counts(timely(spark, folder), "ts", "topic", "1 day")
    alerts = bursts.burst_stream(counts, "1 day", first)
    found = spark.read.schema(bursts.ALERT).parquet(live.run_available(alerts))
    return found.withColumn("bucket", F.col("bucket").cast(NTZ))


@query("live_assigned_events", f"""
WITH {CENTROID_SQL},
best AS (
  SELECT a.vec_id, a.v, b.event_id, {COSINE} AS similarity FROM vecs a, centroids b
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.event_id) = 1)
SELECT vec_id, CASE WHEN similarity >= 0.25 THEN event_id ELSE min(vec_id) OVER (PARTITION BY v) + 1099511627776 END AS event_id,
       similarity, similarity < 0.25 AS opened FROM best""")
def live_assigned_events(spark, folder):
    known = fresh_path(spark, "events")
    start = grouping.centroids_of(vectors(spark, folder), "label", "embedding")
    sinks.write_batch(start, known, 0)
    arriving = live.stream_mentions(spark, landing(folder, "embeddings"), schemas.VECTORS)
    out = assignment.live_assignment(arriving, "vec_id", "embedding", known, fresh_path(spark, "assigned"), 0.25)
    return spark.read.parquet(out).select("vec_id", "event_id", "similarity", "opened")


@query("live_sentiment", f"WITH {SCORED_SQL} SELECT doc_id, round(score, 6) AS score, polarity FROM scored")
def live_sentiment(spark, folder):
    """The lexicon score on a stream of articles equals that of the batch."""
    arriving = live.stream_mentions(spark, landing(folder, "documents"), schemas.ARTICLES)
    scored = sentiment.lexicon_sentiment(arriving, "text").select("doc_id", F.round("score", 6).alias("score"), "polarity")
    return spark.read.parquet(live.run_available(scored))


@query("live_bayes_sentiment", f"WITH {bayes_sql(TOXIC_SQL)} SELECT doc_id, score, CAST(score > 0 AS INTEGER) AS prediction FROM judged")
def live_bayes_sentiment(spark, folder):
    """The trained model on a stream of articles gives what it gives on the batch."""
    model = sentiment.train_bayes(labelled_articles(spark, folder), "text", "toxic")
    arriving = live.stream_mentions(spark, landing(folder, "documents"), schemas.ARTICLES)
    path = live.live_scores(arriving, model, "doc_id", "text", fresh_path(spark, "scores"))
    return spark.read.parquet(path).select("doc_id", F.round("score", 4).alias("score"), "prediction")


@query("written_events", f"""
WITH {POSTS_SQL}
SELECT event_id, ts, user_id, event_type, value, topic, CAST(ts AS DATE) AS day FROM posts""")
def written_events(spark, folder):
    path = fresh_path(spark, "posts")
    rows = posts(spark, folder).drop("props").withColumn("day", F.to_date("ts"))
    sinks.write_events(rows, path, "day")
    return spark.read.parquet(path)
