"""Queries on the activity table: risk and overview."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hot, overview, report, risk, trend
from ..session import cut
from ..functions.durations import bucket_start
from .activity import RECENT_SQL, SERIES_SQL, STAGE_SQL, daily_series, posts
from .registry import query

# On this table the share of "error" rows stands for the negative share and the
# number of distinct users for the spread.
FEATURES_SQL = RECENT_SQL + """,
heat AS (
  SELECT topic, sum(value * exp(-ln(2) / 259200 * (epoch_us(as_of) - epoch_us(ts)) / 1e6)) AS heat
  FROM posts, (SELECT max(ts) AS as_of FROM events) WHERE topic IS NOT NULL GROUP BY topic),
sentiment AS (
  SELECT topic, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS negative_share,
         count(DISTINCT user_id) AS spread
  FROM posts WHERE topic IS NOT NULL GROUP BY topic),
direction AS (SELECT topic, regr_slope(n, t) AS growth FROM recent GROUP BY topic),
features AS (
  SELECT h.topic, round(h.heat, 6) AS heat, round(s.negative_share, 6) AS negative_share,
         round(coalesce(d.growth, 0), 6) AS growth, round(CAST(s.spread AS DOUBLE), 6) AS spread
  FROM heat h JOIN sentiment s ON s.topic = h.topic LEFT JOIN direction d ON d.topic = h.topic)"""

SCORE_SQL = FEATURES_SQL + """,
scored AS (
  SELECT topic, 0.35 * percent_rank() OVER (ORDER BY heat) + 0.30 * percent_rank() OVER (ORDER BY negative_share)
       + 0.20 * percent_rank() OVER (ORDER BY growth) + 0.15 * percent_rank() OVER (ORDER BY spread) AS s
  FROM features),
rated AS (SELECT topic, round(s, 6) AS risk_score,
       CASE WHEN round(s, 6) >= 0.8 THEN 'severe' WHEN round(s, 6) >= 0.6 THEN 'high'
            WHEN round(s, 6) >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level FROM scored)"""


def features(spark, folder):
    rows = posts(spark, folder).where(F.col("topic").isNotNull())
    per_user = rows.groupBy("topic", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")
    )
    sides = per_user.groupBy("topic").agg(
        (F.sum("errors") / F.sum("n")).alias("negative_share"), F.count("user_id").alias("spread")
    )
    return risk.risk_features(
        hot.heat(rows, "ts", "topic", "value", "3 days"),
        sides,
        trend.slope(daily_series(spark, folder)).withColumnRenamed("slope", "growth"),
        sides,
        key="topic",
    )


@query("risk_features", f"WITH {FEATURES_SQL} SELECT * FROM features")
def risk_features(spark, folder):
    return features(spark, folder)


@query("risk_score", f"WITH {SCORE_SQL} SELECT topic, risk_score FROM rated")
def risk_score(spark, folder):
    scored = risk.risk_score(features(spark, folder), key="topic")
    return scored.withColumn("risk_score", F.round("risk_score", 6))


@query("risk_level", f"WITH {SCORE_SQL} SELECT * FROM rated")
def risk_level(spark, folder):
    scored = risk.risk_level(risk.risk_score(features(spark, folder), key="topic"))
    return scored.withColumn("risk_score", F.round("risk_score", 6))


@query("situation_overview", """
SELECT CAST(grouping(day) * 4 + grouping(event_type) * 2 + grouping(polarity) AS INTEGER) AS level,
       day, event_type, polarity, count(*) AS n, round(sum(value), 4) AS weight
FROM (SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, value,
             CASE WHEN event_type = 'error' THEN 'negative' WHEN event_type = 'purchase' THEN 'positive'
                  ELSE 'neutral' END AS polarity FROM events)
GROUP BY CUBE (day, event_type, polarity)""")
def situation_overview(spark, folder):
    kind = F.col("event_type")
    rows = posts(spark, folder).select(
        bucket_start("ts", "1 day").alias("day"),
        "event_type",
        F.when(kind == "error", "negative").when(kind == "purchase", "positive").otherwise("neutral").alias("polarity"),
        "value",
    )
    cube = overview.overview(rows, ["day", "event_type", "polarity"], {"n": F.lit(1), "weight": F.col("value")})
    return cube.withColumn("weight", F.round("weight", 4))


REPORT_SQL = SCORE_SQL + STAGE_SQL[len(SERIES_SQL):]


@query("topic_report", f"""
WITH {REPORT_SQL},
lines AS (SELECT topic, round(regr_slope(n, t), 6) AS slope,
                 round(greatest(regr_intercept(n, t) + 7 * regr_slope(n, t), 0.0), 6) AS projected
          FROM recent GROUP BY topic)
SELECT f.topic, f.heat, f.negative_share, CAST(f.spread AS BIGINT) AS spread, s.stage, s.peak_bucket,
       l.slope, l.projected, r.risk_score, r.risk_level
FROM features f JOIN stages s ON s.topic = f.topic JOIN lines l ON l.topic = f.topic JOIN rated r ON r.topic = f.topic""")
def topic_report(spark, folder):
    facts = cut(features(spark, folder))
    series = cut(daily_series(spark, folder))
    nested = report.assemble(facts.select("topic"), "topic", {
        "heat": facts.select("topic", "heat"),
        "sentiment": facts.select("topic", "negative_share"),
        "propagation": facts.select("topic", F.col("spread").cast("long").alias("spread")),
        "trend": trend.stage(series).join(trend.slope(series), "topic").join(trend.project(series), "topic"),
        "risk": risk.risk_level(risk.risk_score(facts, key="topic")),
    })
    return nested.select(
        "topic", "heat.heat", "sentiment.negative_share", "propagation.spread", "trend.stage", "trend.peak_bucket",
        F.round("trend.slope", 6).alias("slope"), F.round("trend.projected", 6).alias("projected"),
        F.round("risk.risk_score", 6).alias("risk_score"), "risk.risk_level",
    )
