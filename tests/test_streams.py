"""Live runs over several files, held against the batch operators."""

import datetime as dt

from pyspark.sql import functions as F

from hearsay.functions.durations import bucket_start
from hearsay.operators import hot, trend
from hearsay.session import fresh_path
from hearsay.streaming import bursts, live

SCHEMA = "ts timestamp_ntz, topic int, text string"


def land(spark, parts):
    """One file per part, in order of modification time."""
    path = fresh_path(spark, "landing")
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    from pyspark.sql.types import _parse_datatype_string

    return live.stream_mentions(spark, path, _parse_datatype_string(SCHEMA), max_files=1)


def at(hour, minute, day=1):
    return dt.datetime(2024, 3, day, hour, minute)


def test_late_mentions_are_dropped_from_closed_windows(spark):
    path = land(spark, [[(at(10, 5), 1, "")], [(at(13, 30), 1, "")], [(at(13, 40), 1, "")], [(at(10, 40), 1, "")]])
    timely = live.with_lateness(stream(spark, path), "ts", "2 hours")
    out = live.run_available(live.live_counts(timely, "ts", "topic", "1 hour"))
    rows = spark.read.parquet(out).select(F.col("window.start").cast("string").alias("s"), "n").collect()
    assert [(r.s, r.n) for r in rows] == [("2024-03-01 10:00:00", 1)]


def test_live_copies_are_kept_once(spark):
    path = land(spark, [[(at(10, 0), 1, "A b"), (at(10, 1), 1, "c")], [(at(10, 2), 1, "a  B"), (at(10, 3), 1, "d")]])
    kept = live.drop_live_copies(live.with_lateness(stream(spark, path), "ts", "2 hours"), "text")
    texts = {r.text.lower().replace("  ", " ") for r in spark.read.parquet(live.run_available(kept)).collect()}
    out = spark.read.parquet(live.run_available(kept))
    assert texts == {"a b", "c", "d"} and out.count() == 3


def test_bursts_over_several_batches_equal_the_batch(spark):
    counts = {1: [2, 2, 2, 2, 2, 2, 2, 12, 2, 2], 2: [1, 0, 1, 0, 1, 0, 1, 4, 0, 9], 3: [0, 0, 0, 0, 0, 5, 0, 0, 0, 0]}
    days = []
    for d in range(10):
        days.append([(at(1, i, d + 1), t, "") for t, c in counts.items() for i in range(c[d])])
    days.append([(at(1, 0, 12), 9, "")])
    days.append([(at(1, 1, 12), 9, "")])
    path = land(spark, days)
    timely = live.with_lateness(stream(spark, path), "ts", "2 hours")
    batch = spark.read.parquet(path)
    origin = batch.agg(F.min("ts").alias("t")).select(F.unix_timestamp(bucket_start("t", "1 day").cast("timestamp"))).first()[0]
    alerts = bursts.burst_stream(live.live_counts(timely, "ts", "topic", "1 day"), "1 day", origin, repeat=True)
    found = spark.read.schema(bursts.ALERT).parquet(live.run_available(alerts))
    live_rows = sorted((r.topic, r.bucket.day, r.n, r.z) for r in found.collect())
    series = trend.volume_series(batch, "ts", "topic", "1 day")
    batch_rows = sorted((r.topic, r.bucket.day, r.n, r.z) for r in hot.bursts(series).where("topic <> 9").collect())
    assert live_rows == batch_rows and len(live_rows) >= 4


def test_a_live_run_goes_on_where_it_ended(spark):
    path = land(spark, [[(at(10, 5), 1, "a")], [(at(13, 30), 1, "b")]])
    out, progress = fresh_path(spark, "out"), fresh_path(spark, "progress")

    def run():
        timely = live.with_lateness(stream(spark, path), "ts", "2 hours")
        query = live.start(live.live_counts(timely, "ts", "topic", "1 hour"), progress, out)
        query.awaitTermination()
        rows = spark.read.parquet(out).select(F.hour("window.start").alias("h"), "n").collect()
        return sorted((r.h, r.n) for r in rows), live.dropped_late(query), sum(p["numInputRows"] for p in query.recentProgress)

    assert run() == ([(10, 1)], 0, 2)
    for rows in ([(at(13, 40), 1, "c"), (at(10, 40), 1, "late")], [(at(17, 0), 1, "d")]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    # The open window of 13:00 kept its count; the row of 10:40 came too late.
    assert run() == ([(10, 1), (13, 2)], 1, 3)


def test_null_texts_stay_in_live_copies(spark):
    path = land(spark, [[(at(10, 0), 1, "A b"), (at(10, 1), 1, None)], [(at(10, 2), 1, None), (at(10, 3), 1, "a b")]])
    kept = live.drop_live_copies(live.with_lateness(stream(spark, path), "ts", "2 hours"), "text")
    assert sorted(str(r.text) for r in spark.read.parquet(live.run_available(kept)).collect()) == ["A b", "None", "None"]


def test_a_burst_alerts_once_per_crossing(spark):
    daily = [2, 2, 2, 2, 20, 90, 2, 2, 2, 2, 2, 2, 2, 30, 0, 0]
    days = [[(at(1, i % 60, d + 1), 1, "") for i in range(n)] for d, n in enumerate(daily) if n]
    path = land(spark, [*days, [(at(1, 0, 20), 9, "")], [(at(1, 1, 20), 9, "")]])
    timely = live.with_lateness(stream(spark, path), "ts", "2 hours")
    alerts = bursts.burst_stream(live.live_counts(timely, "ts", "topic", "1 day"), "1 day")
    found = spark.read.schema(bursts.ALERT).parquet(live.run_available(alerts)).where("topic = 1")
    # Days 5 and 6 both exceed the cut; one alert.
    assert [r.bucket.day for r in found.orderBy("bucket").collect()] == [5, 14]


def rows_in_state(spark, progress, operator):
    """What the burst processor holds after a run, read from its state store."""
    states = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "past").load(progress)
    return {r.topic for r in states.select("key.topic").collect()}


def test_bursts_of_named_topics_end_and_are_forgotten(spark):
    daily = {"storm": [2, 2, 2, 30, 0, 0, 0, 0, 0, 0, 0, 0, 0], "vote": [1, 1, 1, 1, 1, 1, 1, 1, 9, 2, 1, 1, 1]}
    days = [[(at(1, i % 60, d + 1), t, "") for t, c in daily.items() for i in range(c[d])] for d in range(13)]
    days += [[(at(1, 0, 15), "last", "")], [(at(1, 1, 15), "last", "")]]
    path, progress, out = fresh_path(spark, "landing"), fresh_path(spark, "progress"), fresh_path(spark, "out")
    schema = "ts timestamp_ntz, topic string, text string"
    for rows in days:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    arriving = live.stream_mentions(spark, path, spark.createDataFrame([], schema).schema, max_files=1)
    counts = live.live_counts(live.with_lateness(arriving, "ts", "2 hours"), "ts", "topic", "1 day")
    alerts = bursts.burst_stream(counts, "1 day", turns=True)
    assert dict(alerts.dtypes)["topic"] == "string"
    live.start(alerts, progress, out).awaitTermination()
    found = [(r.topic, r.bucket.day, r.n, r.rising) for r in spark.read.parquet(out).orderBy("topic", "bucket").collect()]
    # The storm ends on its first silent day, the vote on the first day below the cut.
    assert found == [("storm", 4, 30, True), ("storm", 5, 0, False), ("vote", 9, 9, True), ("vote", 10, 2, False)]
    # Seven silent days after its last mention the storm is no longer held; the vote is.
    assert rows_in_state(spark, progress, 0) == {"vote"}


def test_late_rows_are_counted_over_many_batches(spark):
    """More batches than a query remembers; each later hour brings one row too late."""
    hours = [[(dt.datetime(2024, 3, 1) + dt.timedelta(hours=h), 1, "a")] for h in range(115)]
    for h in range(5, 115):
        hours[h].append((dt.datetime(2024, 3, 1), 2, "late"))
    path = land(spark, hours)
    folder = live.keep_late(stream(spark, path), "ts", "2 hours", "1 hour", fresh_path(spark, "parted"))
    late, timely = (spark.read.parquet(f"{folder}/{name}") for name in ("late", "timely"))
    assert late.count() == 110 and {r.topic for r in late.select("topic").distinct().collect()} == {2}
    assert timely.count() == 115 and late.select("batch").distinct().count() == 110
    counts = live.live_counts(live.with_lateness(stream(spark, path), "ts", "2 hours"), "ts", "topic", "1 hour")
    query = live.start(counts, fresh_path(spark, "progress"), fresh_path(spark, "out"))
    query.awaitTermination()
    assert len(query.recentProgress) <= 100 and live.dropped_late(query) == 110


def test_rows_without_a_time_and_resumed_clocks(spark):
    path, folder, progress = land(spark, [[(at(10, 5), 1, "a"), (None, 1, "n")]]), fresh_path(spark, "parted"), fresh_path(spark, "progress")

    def run():
        live.keep_late(stream(spark, path), "ts", "2 hours", "1 hour", folder, progress)
        return {n: sorted(r.text for r in spark.read.parquet(f"{folder}/{n}").collect()) for n in ("late", "timely")}

    assert run() == {"late": [], "timely": ["a", "n"]}
    for rows in ([(at(14, 0), 1, "b")], [(at(10, 59), 1, "too late"), (at(12, 30), 1, "c"), (None, 1, "m")]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        last = run()
    assert last == {"late": ["too late"], "timely": ["a", "b", "c", "m", "n"]}
