"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import time

from hearsay.plans import QUERIES
from hearsay.session import build_session

HEADLINES = [
    "hot_topics_daily", "mention_counts_sliding", "topic_heat", "topic_bursts", "topic_episodes",
    "volume_growth", "risk_level", "situation_overview", "page_articles", "first_copies",
    "lexicon_sentiment", "story_keywords", "event_groups", "reprint_edges_exact", "propagation_tree",
    "bm25_passages", "vector_neighbours", "assigned_events", "question_answer_pairs",
    "live_counts_tumbling", "reprint_edges", "propagation_paths", "story_report", "live_bursts",
    "live_assigned_events", "trained_sentiment",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, partitions=int(cpus))
    run(spark, "hot_topics_daily", folder)  # starts the JVM and compiles the common path
    run(spark, "vector_neighbours", folder)  # starts the Python workers
    times = {name: round(run(spark, name, folder), 3) for name in HEADLINES}
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
