"""Committed tables and author sketches."""

import datetime as dt

import pytest

from hearsay.operators import hot
from hearsay.plans import QUERIES
from hearsay.session import fresh_path
from hearsay.sources import sinks
from hearsay.streaming import live

SCHEMA = "id bigint, text string"


def rows_of(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], SCHEMA)


def held(spark, path):
    return sorted(r.id for r in sinks.read_committed(spark, path, SCHEMA).collect())


def test_a_killed_and_rerun_batch_leaves_no_double_rows(spark):
    path = fresh_path(spark, "committed")
    assert held(spark, path) == [] and sinks.superseded(spark, path) == []
    sinks.commit_batch(rows_of(spark, 1, 2), path, 0)
    # Killed after its rows, before its commit.
    rows_of(spark, 3, 4).write.parquet(f"{path}/data/part-killed")
    assert held(spark, path) == [1, 2]
    sinks.commit_batch(rows_of(spark, 3, 4), path, 1)
    sinks.commit_batch(rows_of(spark, 3, 4), path, 1)  # the whole batch again
    assert held(spark, path) == [1, 2, 3, 4]
    assert len(sinks.superseded(spark, path)) == 2 and "part-killed" in sinks.superseded(spark, path)


def test_a_batch_that_fails_is_not_seen(spark):
    from pyspark.sql import functions as F

    path = fresh_path(spark, "committed")
    sinks.commit_batch(rows_of(spark, 1), path, 0)
    broken = rows_of(spark, 2).withColumn("id", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        sinks.commit_batch(broken, path, 1)
    assert held(spark, path) == [1]


def test_compaction_keeps_rows_and_bounds_folders(spark):
    path = fresh_path(spark, "committed")
    for batch in range(6):
        sinks.commit_batch(rows_of(spark, batch, 10 + batch), path, batch)
    before = held(spark, path)
    sinks.compact(spark, path, SCHEMA, 3)
    assert held(spark, path) == before and len(sinks.committed_folders(spark, path)) == 3
    sinks.commit_batch(rows_of(spark, 2, 12), path, 2)  # a batch that is part of the compaction, run again
    sinks.commit_batch(rows_of(spark, 99), path, 6)
    sinks.compact(spark, path, SCHEMA, 6)
    sinks.compact(spark, path, SCHEMA, 5)
    assert held(spark, path) == sorted([*before, 99]) and len(sinks.committed_folders(spark, path)) == 1
    assert len(sinks.superseded(spark, path)) == 8


def test_a_stream_appends_to_a_committed_table(spark):
    source, path, progress = (fresh_path(spark, n) for n in ("landing", "committed", "progress"))
    schema = rows_of(spark, 1).schema
    for ids in ((1, 2), (3,)):
        rows_of(spark, *ids).coalesce(1).write.mode("append").parquet(source)
        live.append_committed(live.stream_mentions(spark, source, schema, max_files=1), path, progress)
    assert held(spark, path) == [1, 2, 3] and len(sinks.committed_folders(spark, path)) == 2


def test_sketches_roll_up_within_their_error(spark):
    start = dt.datetime(2024, 3, 1)
    rows = [(start + dt.timedelta(hours=i % 200), i % 3 if i % 11 else None, (i * 7919) % 20_011 if i % 5 else None) for i in range(60_000)]
    posts = spark.createDataFrame(rows, "ts timestamp_ntz, topic int, who int")
    hourly = hot.author_sketches(posts, "ts", "topic", "1 hour", "who")
    for by, width, key in ((["bucket", "topic"], "1 day", lambda r: ((r[0] - dt.datetime(1970, 1, 1)).days, r[1])), (["topic"], None, lambda r: r[1])):
        exact, n = {}, {}
        for r in rows:
            if r[1] is not None:
                n[key(r)] = n.get(key(r), 0) + 1
                exact.setdefault(key(r), set()).update({r[2]} - {None})
        for r in hot.count_authors(hot.unite_authors(hourly, *by, width=width)).collect():
            k = ((r.bucket - dt.datetime(1970, 1, 1)).days, r.topic) if width else r.topic
            assert r.n == n[k] and abs(r.authors - len(exact[k])) <= 0.06 * len(exact[k])
    none = hot.author_sketches(posts.where("who is null"), "ts", "topic", "1 day", "who")
    assert {r.authors for r in hot.count_authors(none).collect()} == {0}


def test_many_authors_of_a_week_are_counted_without_error(spark):
    start = dt.datetime(2024, 3, 1)
    rows = [(start + dt.timedelta(hours=i % 300), i % 2, (i * 7919) % 20_011 if i % 5 else None) for i in range(60_000)]
    folder = fresh_path(spark, "authors")
    spark.createDataFrame(
        [(i, ts, who, "post", 1.0, f'{{"k": {topic}}}') for i, (ts, topic, who) in enumerate(rows)],
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    ).write.parquet(f"{folder}/events.parquet")
    want = {}
    for ts, topic, who in rows:
        week = want.setdefault(((ts - dt.datetime(1970, 1, 1)).days // 7, topic), [0, set()])
        week[0] += 1
        week[1].update({who} - {None})
    got = {((r.bucket - dt.datetime(1970, 1, 1)).days // 7, r.topic): [r.n, r.authors] for r in QUERIES["authors_by_week"](spark, folder).collect()}
    assert got == {k: [n, len(a)] for k, (n, a) in want.items()} and max(a for _, a in got.values()) > 5_000
