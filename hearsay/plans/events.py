"""Queries on events of vectors: groups of like vectors, events that live on over batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as search
from ..operators import grouping, living
from .answers import COSINE, vectors
from .registry import query


def links_sql(name: str, rows: str, at: float) -> str:
    """`{name}_of` (id, label): groups of the distinct vectors of `rows` (id, v), each linked to its nearest at `at` or above."""
    return f"""
{name}_heads AS (SELECT min(id) AS id, v FROM {rows} GROUP BY v),
{name}_links AS (
  SELECT a.id AS a, b.id AS b FROM {name}_heads a JOIN {name}_heads b ON a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {COSINE} DESC, b.id) = 1 AND {COSINE} >= {at}),
{name}_both AS (SELECT a, b FROM {name}_links UNION SELECT b, a FROM {name}_links),
{name}_reach(id, label) AS (
  SELECT id, id FROM {name}_heads UNION SELECT l.b, r.label FROM {name}_reach r JOIN {name}_both l ON l.a = r.id),
{name}_labels AS (SELECT id, min(label) AS label FROM {name}_reach GROUP BY id),
{name}_of AS (SELECT x.id, l.label FROM {rows} x JOIN {name}_heads h ON h.v = x.v JOIN {name}_labels l ON l.id = h.id)"""


MEAN = "list(x ORDER BY pos)"
TOGETHER, JOINS, MERGES = 0.4, 0.36, 0.42
OPENED = grouping.NEW_EVENTS_FROM


def mean_sql(name: str, rows: str) -> str:
    """`{name}` (event_id, v, n): mean vectors of `rows` (event_id, v, w), weighted by w."""
    return f"""
{name}_cells AS (SELECT event_id, w, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {rows}),
{name}_means AS (SELECT event_id, pos, sum(x * w) / sum(w) AS x FROM {name}_cells GROUP BY 1, 2),
{name}_sizes AS (SELECT event_id, CAST(sum(w) AS BIGINT) AS n FROM {rows} GROUP BY 1),
{name} AS (SELECT event_id, v, n FROM (SELECT event_id, list(x ORDER BY pos) AS v FROM {name}_means GROUP BY 1) JOIN {name}_sizes USING (event_id))"""


def merge_sql(name: str, rows: str) -> str:
    """`{name}` (event_id, v, n, last): `rows` (id, v, n, last) after their union, `{name}_to` (id, label) being who became whom."""
    return f"""
{links_sql(name + "m", rows, MERGES)},
{name}_to AS (SELECT id, label FROM {name}m_of),
{name}_parts AS (SELECT t.label AS event_id, r.v, r.n AS w, r.last FROM {rows} r JOIN {name}_to t ON t.id = r.id),
{mean_sql(name + "v", name + "_parts")},
{name} AS (SELECT p.event_id, any_value(m.v) AS v, any_value(m.n) AS n, max(p.last) AS last
  FROM {name}_parts p JOIN {name}v m ON m.event_id = p.event_id GROUP BY p.event_id)"""


# Mentions of the lower half of the ids come first, the others second.
LIVING_SQL = f"""
mentions AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN 2 * vec_id <= lo + hi THEN 0 ELSE 1 END AS batch
  FROM embeddings, (SELECT min(vec_id) AS lo, max(vec_id) AS hi FROM embeddings)),
b0 AS (SELECT id, v FROM mentions WHERE batch = 0),
{links_sql("g0", "b0", TOGETHER)},
joined0 AS (SELECT label + {OPENED} AS event_id, v, 1 AS w FROM b0 JOIN g0_of USING (id)),
{mean_sql("e0", "joined0")},
r0 AS (SELECT event_id AS id, v, n, 0 AS last FROM e0),
{merge_sql("s0", "r0")},
b1 AS (SELECT id, v FROM mentions WHERE batch = 1),
best AS (
  SELECT a.id, a.v, b.event_id, {COSINE} AS similarity FROM b1 a, s0 b
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {COSINE} DESC, b.event_id) = 1),
lone AS (SELECT id, v FROM best WHERE similarity < {JOINS}),
{links_sql("g1", "lone", TOGETHER)},
assigned AS (
  SELECT id, 0 AS batch, label + {OPENED} AS event_id, CAST(NULL AS DOUBLE) AS similarity, true AS opened FROM g0_of
  UNION ALL
  SELECT b.id, 1, CASE WHEN similarity < {JOINS} THEN g.label + {OPENED} ELSE event_id END, similarity, similarity < {JOINS}
  FROM best b LEFT JOIN g1_of g ON g.id = b.id),
parts1 AS (
  SELECT event_id, v, n AS w FROM s0
  UNION ALL SELECT a.event_id, m.v, 1 FROM assigned a JOIN mentions m ON m.id = a.id WHERE a.batch = 1),
{mean_sql("e1", "parts1")},
r1 AS (
  SELECT event_id AS id, v, n, CASE WHEN event_id IN (SELECT event_id FROM assigned WHERE batch = 1) THEN 1 ELSE 0 END AS last FROM e1),
{merge_sql("s1", "r1")},
renamed AS (
  SELECT t.id AS old_id, coalesce(u.label, t.label) AS event_id FROM s0_to t LEFT JOIN s1_to u ON u.id = t.label WHERE t.id <> t.label
  UNION ALL SELECT id, label FROM s1_to WHERE id <> label)"""


def run_batches(spark, folder):
    """((assigned with batch), events, aliases) after the two halves of the vectors."""
    rows = vectors(spark, folder)
    lo, hi = rows.agg(F.min("vec_id"), F.max("vec_id")).first()
    first = F.col("vec_id") * 2 <= F.lit((lo or 0) + (hi or 0))
    events, aliases = living.no_events(spark)
    seen = None
    for batch, part in enumerate((rows.where(first), rows.where(~first))):
        assigned, events, aliases = living.advance(
            events, aliases, part, "vec_id", "embedding", batch, JOINS, TOGETHER, MERGES, retire_after=1)
        assigned = assigned.withColumn("batch", F.lit(batch))
        seen = assigned if seen is None else seen.unionByName(assigned)
    return seen, events, aliases


@query("vector_event_groups", f"""
WITH RECURSIVE vecs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
{links_sql("g", "vecs", TOGETHER)}
SELECT id AS vec_id, label AS event_id FROM g_of""")
def vector_event_groups(spark, folder):
    return grouping.group_alike(vectors(spark, folder), "vec_id", "embedding", TOGETHER)


@query("living_mentions", f"""
WITH RECURSIVE {LIVING_SQL}
SELECT a.id AS vec_id, a.batch, a.event_id, coalesce(r.event_id, a.event_id) AS current_id, a.similarity, a.opened
FROM assigned a LEFT JOIN renamed r ON r.old_id = a.event_id""")
def living_mentions(spark, folder):
    """Which event each mention joined, and under which id that event goes on after the last batch."""
    seen, _, aliases = run_batches(spark, folder)
    return living.current(seen, aliases).select("vec_id", "batch", "event_id", "current_id", "similarity", "opened")


@query("living_events", f"""
WITH RECURSIVE {LIVING_SQL}
SELECT event_id, n AS weight, CAST(last AS INTEGER) AS last_batch, last < 1 AS retired,
       round(sqrt(list_dot_product(v, v)), 6) AS length FROM s1""")
def living_events(spark, folder):
    """The events after the last batch; `length` is that of their mean vector."""
    _, events, _ = run_batches(spark, folder)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    return events.select("event_id", "weight", "last_batch", "retired", F.round(length, 6).alias("length"))


@query("vector_neighbours_probed", """
SELECT CAST(count(*) * 10 AS BIGINT) AS asked, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0""")
def vector_neighbours_probed(spark, folder):
    """The ten nearest of every fiftieth vector by probing trained cells, held against the exact search: recall 0.9 at least."""
    rows = vectors(spark, folder).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 50 = 0")
    cells = search.build_cells(rows)
    different = asked.where("vector is not null").select("vector").distinct().count()
    found = search.ranked(search.search(cells, asked, 10, True, probes=search.tune(cells, 10, asked=different).probes), 10)
    truth = search.nearest(asked, rows, 10, True)
    hits = truth.join(found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("asked"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))
