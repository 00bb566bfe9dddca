"""Events that live on: opening, merging, retiring, resuming."""

import random

import numpy as np

from hearsay import session
from hearsay.functions import vectors
from hearsay.operators import grouping, living
from hearsay.session import fresh_path
from hearsay.streaming import assignment, live

NEW = grouping.NEW_EVENTS_FROM
SCHEMA = "id bigint, vector array<double>"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_nearly_equal_mentions_open_one_event(spark):
    known = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "event_id bigint, vector array<double>")
    rows = [(10, [0.0, 1.0, 0.0]), (11, [0.0, 1.0, 0.001]), (12, [0.0, 0.999, 0.0]), (13, [0.0, 0.0, 1.0]), (14, [2.0, 0.1, 0.0]),
            (15, None), (16, [0.0, 1.0, 0.0])]
    got = {r.id: (r.event_id, r.opened) for r in grouping.assign_events(rows_of(spark, rows), "id", "vector", known, 0.8).collect()}
    assert got == {10: (10 + NEW, True), 11: (10 + NEW, True), 12: (10 + NEW, True), 16: (10 + NEW, True),
                   13: (13 + NEW, True), 14: (1, False), 15: (None, False)}


def test_more_targets_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(1)
    targets = [(i, rng.normal(size=5).tolist()) for i in range(50)] + [(50, None), (7, [0.0] * 5)]
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(40, None)]
    got = {r.id: (r.target, r.similarity) for r in vectors.best_match(rows_of(spark, rows), "vector", targets).collect()}
    for i, v in rows[:-1]:
        scores = [(-round(float(np.dot(v, t) / (np.linalg.norm(v) * (np.linalg.norm(t) or 1))), 6), k) for k, t in targets if t is not None]
        best = min(scores)
        assert got[i] == (best[1], -best[0])
    assert got[40] == (None, None)


def near_graph(rows, least):
    """Groups by plain Python: each distinct vector tied to its nearest other one."""
    heads = {}
    for i, v in rows:
        if v is not None:
            heads[tuple(v)] = min(i, heads.get(tuple(v), i))
    ids, unit = list(heads.values()), {i: np.array(v) / (np.linalg.norm(v) or 1) for v, i in heads.items()}
    label = {i: i for i in ids}
    links = []
    for i in ids:
        scored = [(-round(float(unit[i] @ unit[j]), 6), j) for j in ids if j != i]
        if scored and -min(scored)[0] >= least:
            links.append((i, min(scored)[1]))
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: None if v is None else label[heads[tuple(v)]] for i, v in rows}


def test_groups_of_vectors_on_both_routes(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 6))
    rows = [(i, (centres[i % 8] + rng.normal(size=6) * 0.2).tolist()) for i in range(150)]
    rows += [(500 + i, rows[3][1]) for i in range(60)] + [(900, None)]
    random.Random(1).shuffle(rows)
    table, want = rows_of(spark, rows), near_graph(rows, 0.97)
    for bound in (1000, 10):
        got = {r.id: r.event_id for r in grouping.group_alike(table, "id", "vector", 0.97, bound).collect()}
        assert got == want
    assert len(set(want.values())) < 120
    assert grouping.group_alike(table.limit(0), "id", "vector", 0.97).count() == 0


def test_probing_reaches_its_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12))
    rows = rows_of(spark, [(i, (centres[i % 30] + rng.normal(size=12) * 0.5).tolist()) for i in range(3_000)])
    cells = vectors.build_cells(rows)
    assert 50 <= len(cells.numbers) <= 55 and cells.sizes.sum() == 3_000
    tuned = vectors.tune(cells, 5)
    asked = rows.where("id % 10 = 1")
    found = {(r.query_id, r.item_id) for r in vectors.ranked(vectors.search(cells, asked, 5, True, probes=tuned.probes), 5).collect()}
    truth = {(r.query_id, r.item_id) for r in vectors.nearest(asked, rows, 5, True).collect()}
    assert len(found & truth) >= 0.9 * len(truth) and tuned.share < 0.5


def test_exact_search_copies_a_query_once_a_block(spark, monkeypatch):
    """In many dimensions every cell is visited; a query is written per block of cells, not per cell."""
    written = []
    monkeypatch.setattr(session, "cut", lambda df, cut=session.cut: written.append(cut(df)) or written[-1])
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(2_000)] + [(5_000 + i, [1.0] * 32) for i in range(500)]
    table = rows_of(spark, rows)
    got = vectors.nearest(table, table, 3, skip_self=True, bound=10)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in vectors.nearest(table, table, 3, skip_self=True).collect()}
    assert max(t.count() for t in written) <= 6 * len(rows)


def test_best_of_many_ties_are_the_least_ids():
    ids, items = np.arange(100, 10_100), np.ones((10_000, 4)) / 2
    for k in (3, 40):
        kept = vectors.no_best(2, k)
        vectors.keep_best(kept, np.array([101, 9_000]), items[:2], ids, items, True)
        assert kept[1].tolist() == [[i for i in range(100, 102 + k) if i != q][:k] for q in (101, 9_000)]
        assert (kept[0] == 1).all()


def test_events_extend_merge_and_retire(spark):
    def vector(x, y, z=0.0):
        return [float(x), float(y), float(z)]

    events, aliases = living.no_events(spark)
    rules = dict(min_similarity=0.95, together=0.99, merge_at=0.95, retire_after=2)
    first = [(1, vector(1, 0)), (2, vector(1, 0.01)), (3, vector(0.9, 0.44)), (4, vector(0, 0, 1))]
    assigned, events, aliases = living.advance(events, aliases, rows_of(spark, first), "id", "vector", 0, **rules)
    assert {r.id: r.event_id - NEW for r in assigned.collect()} == {1: 1, 2: 1, 3: 3, 4: 4} and aliases.count() == 0
    # Mentions between the first two events draw the second one near: they go on as the older one.
    second = [(5, vector(0.97, 0.242)), (6, vector(0.97, 0.243))]
    assigned, events, aliases = living.advance(events, aliases, rows_of(spark, second), "id", "vector", 1, **rules)
    now = {r.event_id - NEW: (r.weight, r.last_batch, r.retired) for r in events.collect()}
    assert now[1][:2] == (5, 1) and set(now) == {1, 4} and now[4] == (1, 0, False)
    assert {(r.old_id - NEW, r.event_id - NEW) for r in aliases.collect()} == {(3, 1)}
    mean = events.where(f"event_id = {1 + NEW}").first().vector
    assert np.allclose(mean, np.mean([v for i, v in first + second if i != 4], axis=0))
    # Two batches without a mention retire an event; what comes later opens another.
    assigned, events, aliases = living.advance(events, aliases, rows_of(spark, [(7, vector(1, 0.1))]), "id", "vector", 2, **rules)
    assert {r.event_id - NEW: r.retired for r in events.collect()} == {1: False, 4: True}
    assigned, events, aliases = living.advance(events, aliases, rows_of(spark, [(8, vector(0, 0, 2)), (9, None)]), "id", "vector", 3, **rules)
    assert {r.id: r.event_id for r in assigned.collect()} == {8: 8 + NEW, 9: None}
    assert {r.event_id - NEW: r.retired for r in events.collect()} == {1: False, 4: True, 8: False}
    old = spark.createDataFrame([(3, 3 + NEW), (4, 4 + NEW)], "id bigint, event_id bigint")
    assert {r.id: r.current_id - NEW for r in living.current(old, aliases).collect()} == {3: 1, 4: 4}


def test_aliases_stay_flat(spark):
    """An event merged twice is one step away from its last id."""
    events = spark.createDataFrame(
        [(5, [1.0, 0.0], 1, 0, False), (9, [0.9, 0.44], 1, 0, False)], living.EVENTS)
    aliases = spark.createDataFrame([(12, 9)], living.ALIASES)
    _, events, aliases = living.advance(
        events, aliases, rows_of(spark, [(1, [0.9, 0.4])]), "id", "vector", 1, min_similarity=0.9, merge_at=0.85)
    assert {(r.old_id, r.event_id) for r in aliases.collect()} == {(9, 5), (12, 5)}
    assert [(r.event_id, r.weight) for r in events.collect()] == [(5, 3)]


def land(spark, path, rows):
    rows_of(spark, rows).coalesce(1).write.mode("append").parquet(path)


def test_live_events_go_on_where_they_ended(spark):
    path, folder, progress = (fresh_path(spark, n) for n in ("landing", "living", "progress"))
    land(spark, path, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        arriving = live.stream_mentions(spark, path, schema, max_files=1)
        assignment.live_events(arriving, "id", "vector", folder, 0.9, progress=progress, retire_after=1)
        return {r.id: (r.event_id - NEW, r.batch) for r in spark.read.parquet(f"{folder}/assigned").collect()}

    assert run() == {1: (1, 0), 2: (2, 0)}
    land(spark, path, [(3, [1.0, 0.1])])
    assert run() == {1: (1, 0), 2: (2, 0), 3: (1, 1)}
    events = assignment.read_state(spark, folder, "events", 1)
    assert {r.event_id - NEW: (r.weight, r.retired) for r in events.collect()} == {1: (2, False), 2: (1, True)}


def test_live_assignment_goes_on(spark):
    path, known, out, progress = (fresh_path(spark, n) for n in ("landing", "known", "out", "progress"))
    start = spark.createDataFrame([(1, [1.0, 0.0])], "event_id bigint, vector array<double>")
    start.write.parquet(f"{known}/batch=0")
    schema = spark.createDataFrame([], SCHEMA).schema
    land(spark, path, [(5, [0.0, 1.0])])
    for expected in ({5: 5 + NEW}, {5: 5 + NEW, 6: 5 + NEW, 7: 1}):
        arriving = live.stream_mentions(spark, path, schema, max_files=1)
        assignment.live_assignment(arriving, "id", "vector", known, out, 0.9, progress=progress)
        assert {r.id: r.event_id for r in spark.read.parquet(out).collect()} == expected
        if len(expected) == 1:
            land(spark, path, [(6, [0.1, 1.0]), (7, [1.0, 0.0])])
    # The second run made one batch, not both again.
    assert spark.read.parquet(out).select("batch").distinct().count() == 2


def test_probes_hold_for_other_queries():
    rng = np.random.default_rng(5)

    def needed(n):  # the neighbours of a query lie together or far apart
        return np.ceil(rng.exponential(rng.choice([2.0, 12.0], (n, 1), p=[0.7, 0.3]), (n, 10))).astype(int) + 1

    reached = []
    for _ in range(200):
        sample, others = needed(200), needed(200)
        reached.append((others <= vectors.fewest_probes(sample, 0.9, len(others))).mean() >= 0.9)
    assert all(reached)
