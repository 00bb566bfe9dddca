"""Landed files as DataFrames with fixed schemas, and the canonical mentions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.web import article_columns, canonical_url, site_of


def _read(spark: SparkSession, path: str, schema, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def spread_small(df: DataFrame) -> DataFrame:
    """Deal a small input out to all cores before heavy per-row work.

    An input with fewer scan splits than cores holds at most cores x
    maxPartitionBytes, so moving it is cheap; a larger one is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed news pages: page_id, url, html."""
    return spread_small(_read(spark, path, schemas.PAGES, fmt))


def read_articles(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed article texts: doc_id, text, lang, source, n_chars."""
    return spread_small(_read(spark, path, schemas.ARTICLES, fmt))


def read_posts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed social activity, with the topic taken from the JSON properties."""
    return with_topic(_read(spark, path, schemas.ACTIVITY, fmt))


def read_vectors(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.VECTORS, fmt)


def read_dialogues(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.DIALOGUES, fmt)


def with_topic(posts: DataFrame) -> DataFrame:
    return posts.withColumn("topic", F.get_json_object("props", "$.k").cast("int"))


def _conform(df: DataFrame) -> DataFrame:
    """Cast to the mention schema; columns a source lacks become null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.MENTIONS
    ])


def mentions_from_pages(pages: DataFrame) -> DataFrame:
    title, lang, body = article_columns("html")
    return _conform(pages.select(
        F.concat_ws(":", F.lit("news"), F.lit("page"), "page_id").alias("mention_id"),
        F.lit("news").alias("platform"),
        site_of("url").alias("site"),
        canonical_url("url").alias("url"),
        lang.alias("lang"),
        title.alias("title"),
        body.alias("text"),
        F.lit(1.0).alias("weight"),
    ))


def mentions_from_articles(articles: DataFrame) -> DataFrame:
    return _conform(articles.select(
        F.concat_ws(":", F.lit("news"), F.lit("doc"), "doc_id").alias("mention_id"),
        F.lit("news").alias("platform"),
        F.col("source").alias("site"),
        "lang",
        "text",
        F.lit(1.0).alias("weight"),
    ))


def mentions_from_posts(posts: DataFrame) -> DataFrame:
    return _conform(posts.select(
        F.concat_ws(":", F.lit("social"), "event_id").alias("mention_id"),
        F.lit("social").alias("platform"),
        F.col("event_type").alias("site"),
        F.col("user_id").alias("author_id"),
        F.col("props").alias("text"),
        F.col("ts").alias("published_at"),
        F.col("value").alias("weight"),
    ))


def union_mentions(*parts: DataFrame) -> DataFrame:
    """One mention table out of several; missing columns become null."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.withColumn("weight", F.coalesce(F.col("weight"), F.lit(1.0)))
