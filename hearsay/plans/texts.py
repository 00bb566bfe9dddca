"""Queries on landed pages and articles: extraction, merging, sentiment, keywords."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from ..functions.web import canonical_url, extract_article, site_of
from ..operators import cleaning, keywords, overview, sentiment
from ..sources import tables
from .registry import query, table

WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')"
COPY_SQL = r"md5(lower(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'))))"


def _quoted(words):
    return ", ".join(f"'{w}'" for w in words)


ADDRESS_SQL = r"""
addresses AS (
  SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^(www|m)\.', '') AS site,
         regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '(\.html?)?/*$', '') AS path
  FROM pages)"""

PAGE_SQL = r"""
stripped AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'),
      '(?is)<nav\b.*?</nav>', ' ', 'g'), '(?is)<footer\b.*?</footer>', ' ', 'g'),
      '(?is)<!--.*?-->', ' ', 'g') AS rest
  FROM pages),
bodies AS (
  SELECT page_id, html, trim(regexp_replace(regexp_replace(
      CASE WHEN regexp_extract(rest, '(?is)<article[^>]*>(.*)</article>', 1) <> ''
           THEN regexp_extract(rest, '(?is)<article[^>]*>(.*)</article>', 1) ELSE rest END,
      '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g')) AS body,
    regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS head
  FROM stripped),
articles AS (
  SELECT page_id,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(head, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
      '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n\f]+', ' ', 'g')) AS title,
    nullif(lower(regexp_extract(html, '(?is)<html[^>]*\blang=["'']?([a-z]+)', 1)), '') AS lang,
    replace(replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
      '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS text
  FROM bodies)"""

SCORED_SQL = f"""
hits AS (
  SELECT doc_id, lang, source,
         len(list_filter({WORDS_SQL}, lambda t: t IN ({_quoted(sentiment.POSITIVE)}))) AS pos,
         len(list_filter({WORDS_SQL}, lambda t: t IN ({_quoted(sentiment.NEGATIVE)}))) AS neg
  FROM documents),
scored AS (
  SELECT doc_id, lang, source, (pos - neg) / CAST(greatest(pos + neg, 1) AS DOUBLE) AS score,
         CASE WHEN pos > neg THEN 'positive' WHEN pos < neg THEN 'negative' ELSE 'neutral' END AS polarity
  FROM hits)"""


def pages(spark, folder):
    return tables.read_pages(spark, table(folder, "pages"))


def articles(spark, folder):
    return tables.read_articles(spark, table(folder, "documents"))


def scored_articles(spark, folder):
    return sentiment.lexicon_sentiment(articles(spark, folder), "text")


@query("news_pages", "SELECT page_id, url, html FROM pages")
def news_pages(spark, folder):
    return pages(spark, folder)


@query("page_addresses", f"WITH {ADDRESS_SQL} SELECT page_id, site, site || path AS canonical_url FROM addresses")
def page_addresses(spark, folder):
    return pages(spark, folder).select(
        "page_id", site_of("url").alias("site"), canonical_url("url").alias("canonical_url")
    )


@query("page_articles", f"WITH {PAGE_SQL} SELECT page_id, title, lang, text FROM articles")
def page_articles(spark, folder):
    return extract_article(pages(spark, folder)).select("page_id", "title", "lang", "text")


MENTIONS_SQL = """
SELECT 'news:page:' || a.page_id AS mention_id, 'news' AS platform, d.site, CAST(NULL AS VARCHAR) AS author_id,
       d.site || d.path AS url, a.lang, a.title, a.text, CAST(NULL AS TIMESTAMP) AS published_at, CAST(1.0 AS DOUBLE) AS weight
FROM articles a JOIN addresses d ON d.page_id = a.page_id
UNION ALL
SELECT 'news:doc:' || doc_id, 'news', source, NULL, NULL, lang, NULL, text, NULL, 1.0 FROM documents
UNION ALL
SELECT 'social:' || event_id, 'social', event_type, CAST(user_id AS VARCHAR), NULL, NULL, NULL, props, ts, value FROM events"""


def canonical_mentions(spark, folder):
    return tables.union_mentions(
        tables.mentions_from_pages(pages(spark, folder)),
        tables.mentions_from_articles(articles(spark, folder)),
        tables.mentions_from_posts(tables.read_posts(spark, table(folder, "events"))),
    )


@query("merged_mentions", f"WITH {ADDRESS_SQL}, {PAGE_SQL} {MENTIONS_SQL}")
def merged_mentions(spark, folder):
    return canonical_mentions(spark, folder)


@query("first_copies", f"""
SELECT doc_id, lang, source, text FROM documents
QUALIFY row_number() OVER (PARTITION BY {COPY_SQL} ORDER BY doc_id) = 1""")
def first_copies(spark, folder):
    kept = cleaning.drop_exact_copies(articles(spark, folder), "text", "doc_id")
    return kept.select("doc_id", "lang", "source", "text")


@query("exact_copy_groups", f"""
SELECT {COPY_SQL} AS copy_key, min(doc_id) AS event_id, count(*) AS copies FROM documents GROUP BY 1""")
def exact_copy_groups(spark, folder):
    return cleaning.exact_groups(articles(spark, folder), "doc_id", "text")


@query("lexicon_sentiment", f"WITH {SCORED_SQL} SELECT doc_id, round(score, 6) AS score, polarity FROM scored")
def lexicon_sentiment(spark, folder):
    return scored_articles(spark, folder).select("doc_id", F.round("score", 6).alias("score"), "polarity")


@query("lexicon_sentiment_joined", f"WITH {SCORED_SQL} SELECT doc_id, round(score, 6) AS score, polarity FROM scored")
def lexicon_sentiment_joined(spark, folder):
    lexicon = spark.createDataFrame(list(sentiment.LEXICON.items()), "term string, polarity int")
    joined = sentiment.lexicon_sentiment_joined(articles(spark, folder), "doc_id", "text", lexicon)
    return joined.withColumn("score", F.round("score", 6))


SHARES_SQL = """count(*) AS n, round(avg(score), 6) AS mean_score,
       round(avg(CASE WHEN polarity = 'positive' THEN 1.0 ELSE 0.0 END), 6) AS positive_share,
       round(avg(CASE WHEN polarity = 'neutral' THEN 1.0 ELSE 0.0 END), 6) AS neutral_share,
       round(avg(CASE WHEN polarity = 'negative' THEN 1.0 ELSE 0.0 END), 6) AS negative_share"""


@query("sentiment_by_source", f"WITH {SCORED_SQL} SELECT source, lang, {SHARES_SQL} FROM scored GROUP BY source, lang")
def sentiment_by_source(spark, folder):
    shares = sentiment.sentiment_by(scored_articles(spark, folder), "source", "lang")
    return shares.select("source", "lang", "n", *[
        F.round(c, 6).alias(c) for c in ("mean_score", "positive_share", "neutral_share", "negative_share")
    ])


@query("sentiment_by_language_wide", f"""
WITH {SCORED_SQL}
SELECT lang, count(*) FILTER (WHERE polarity = 'positive') AS positive,
       count(*) FILTER (WHERE polarity = 'neutral') AS neutral,
       count(*) FILTER (WHERE polarity = 'negative') AS negative FROM scored GROUP BY lang""")
def sentiment_by_language_wide(spark, folder):
    return sentiment.sentiment_wide(scored_articles(spark, folder), "lang")


@query("source_overview", f"""
WITH {SCORED_SQL}
SELECT CAST(grouping(lang) * 4 + grouping(source) * 2 + grouping(polarity) AS INTEGER) AS level,
       lang, source, polarity, count(*) AS n FROM scored GROUP BY ROLLUP (lang, source, polarity)""")
def source_overview(spark, folder):
    return overview.overview(
        scored_articles(spark, folder), ["lang", "source", "polarity"], {"n": F.lit(1)}, depth="rollup"
    )


@query("trained_sentiment")
def trained_sentiment(spark, folder):
    labels = spark.read.parquet(table(folder, "labels"))
    labelled = articles(spark, folder).join(labels, "doc_id")
    model, _ = sentiment.train_sentiment(labelled, "doc_id", "text", "toxic")
    scored = sentiment.score_sentiment(model, articles(spark, folder), "text")
    return scored.select("doc_id", "lang", "source", F.round("probability", 6).alias("negative_probability"), "prediction")


@query("trained_sentiment_checked", "SELECT doc_id, lang, source, true AS scored FROM documents")
def trained_sentiment_checked(spark, folder):
    """What is fixed about the scores: one probability per article, and the prediction it gives."""
    scored = trained_sentiment(spark, folder)
    agrees = (F.col("negative_probability") > 0.5) == (F.col("prediction") == 1.0)
    close = F.abs(F.col("negative_probability") - 0.5) < 1e-6
    return scored.select(
        "doc_id", "lang", "source", (F.col("negative_probability").between(0, 1) & (agrees | close)).alias("scored"))


@query("trained_sentiment_quality_checked", "SELECT true AS ranks")
def trained_sentiment_quality_checked(spark, folder):
    """The held-out articles are ranked better than by chance; so few that chance decides also pass."""
    quality = trained_sentiment_quality(spark, folder)
    return quality.select(((F.col("auc") >= 0.6) | (F.col("positives") < 5)).alias("ranks"))


@query("trained_sentiment_quality")
def trained_sentiment_quality(spark, folder):
    labels = spark.read.parquet(table(folder, "labels"))
    labelled = articles(spark, folder).join(labels, "doc_id")
    model, held_out = sentiment.train_sentiment(labelled, "doc_id", "text", "toxic")
    auc = BinaryClassificationEvaluator().evaluate(model.transform(held_out))
    return held_out.agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("positives")).withColumn(
        "auc", F.lit(round(auc, 6))
    )


def bayes_sql(labelled: str) -> str:
    """`judged` (doc_id, score): log odds of every document by naive Bayes over the rows (text, y) of `labelled`."""
    return f"""
known AS (SELECT text, y FROM ({labelled}) WHERE y IN (0, 1)),
counted AS (
  SELECT term, sum(y) AS ones, sum(1 - y) AS zeros FROM (SELECT y, unnest({WORDS_SQL}) AS term FROM known) GROUP BY term),
sums AS (SELECT coalesce(sum(ones), 0) AS ones, coalesce(sum(zeros), 0) AS zeros, count(*) AS vocabulary FROM counted),
classes AS (SELECT count(*) FILTER (y = 1) AS ones, count(*) FILTER (y = 0) AS zeros FROM known),
gains AS (SELECT term, ln((ones + 1) / CAST(zeros + 1 AS DOUBLE)) AS gain FROM counted),
doc_terms AS (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents),
gained AS (SELECT doc_id, sum(gain) AS gain FROM doc_terms JOIN gains USING (term) GROUP BY doc_id),
judged AS (
  SELECT d.doc_id, round(ln((c.ones + 1) / CAST(c.zeros + 1 AS DOUBLE))
    + len({WORDS_SQL}) * ln((s.zeros + s.vocabulary + 1) / CAST(s.ones + s.vocabulary + 1 AS DOUBLE)) + coalesce(g.gain, 0), 4) AS score
  FROM documents d LEFT JOIN gained g ON g.doc_id = d.doc_id, sums s, classes c)"""


TOXIC_SQL = "SELECT d.text, l.toxic AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id"


def labelled_articles(spark, folder):
    return articles(spark, folder).join(spark.read.parquet(table(folder, "labels")), "doc_id")


@query("bayes_sentiment", f"WITH {bayes_sql(TOXIC_SQL)} SELECT doc_id, score, CAST(score > 0 AS INTEGER) AS prediction FROM judged")
def bayes_sentiment(spark, folder):
    model = sentiment.train_bayes(labelled_articles(spark, folder), "text", "toxic")
    scored = sentiment.score_bayes(model, articles(spark, folder), "doc_id", "text")
    return scored.withColumn("score", F.round("score", 4))


@query("bayes_sentiment_quality", f"""
WITH {bayes_sql(TOXIC_SQL + " WHERE l.doc_id % 5 <> 0")}
SELECT CAST(l.toxic AS INTEGER) AS label, CAST(j.score > 0 AS INTEGER) AS prediction, count(*) AS n
FROM judged j JOIN labels l ON l.doc_id = j.doc_id WHERE l.doc_id % 5 = 0 GROUP BY 1, 2""")
def bayes_sentiment_quality(spark, folder):
    """How the labels of every fifth document are met by a model that has not seen them."""
    labelled = labelled_articles(spark, folder)
    apart = F.col("doc_id") % 5 == 0
    model = sentiment.train_bayes(labelled.where(~apart), "text", "toxic")
    scored = sentiment.score_bayes(model, labelled.where(apart), "doc_id", "text")
    met = scored.join(labelled.select("doc_id", F.col("toxic").cast("int").alias("label")), "doc_id")
    return met.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("story_keywords", f"""
WITH stories AS (
  SELECT min(doc_id) OVER (PARTITION BY {COPY_SQL}) AS event_id, text FROM documents),
tf AS (
  SELECT event_id, term, count(*) AS tf
  FROM (SELECT event_id, unnest({WORDS_SQL}) AS term FROM stories) GROUP BY event_id, term),
spread AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
total AS (SELECT count(DISTINCT event_id) AS events FROM stories),
weights AS (
  SELECT tf.event_id, tf.term, round(tf.tf * ln((events + 1) / CAST(n + 1 AS DOUBLE)), 6) AS weight
  FROM tf JOIN spread ON spread.term = tf.term, total)
SELECT event_id, term, weight, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM weights)
WHERE rank <= 5""")
def story_keywords(spark, folder):
    rows = articles(spark, folder)
    return keywords.keywords(cleaning.with_event_id(rows, "doc_id", "text"), "event_id", "text", 5)
