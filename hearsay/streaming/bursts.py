"""Burst alerts on a stream of closed windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.durations import seconds


def alert_schema(topic: str, turns: bool = False) -> str:
    return f"topic {topic}, bucket timestamp, n bigint, z double" + (", rising boolean" if turns else "")


ALERT = alert_schema("int")


class BurstProcessor(StatefulProcessor):
    """Keeps the last counts of one topic and scores each newly closed window.

    Windows without mentions never arrive; they count as zeros between the last
    window seen (or `origin`, the first window of the stream) and the next one. A
    topic is above the cut from the window that crosses it to the first below.

    A timer in event time closes what no mention closes: the first silent window after a
    burst ends it, and after `forget` silent windows the state goes.
    """

    def __init__(
        self, step: int, origin: int | None, z: float, history: int, min_history: int, repeat: bool, forget: int, turns: bool,
    ):
        self.step, self.origin, self.z, self.repeat = step, origin, z, repeat
        self.history, self.min_history, self.forget, self.turns = history, min_history, forget, turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", "until bigint, counts array<bigint>, above boolean, timer bigint")

    def _score(self, counts: list[int], n: int) -> float | None:
        if len(counts) < self.min_history:
            return None
        spread = max(float(np.std(counts, ddof=1)), 1.0)
        return round((n - float(np.mean(counts))) / spread, 6)

    def _set(self, until: int, counts: list[int], above: bool, at: int, old: int | None) -> None:
        """Store the state with its one timer, in milliseconds."""
        if old is not None and old != at:
            self.handle.deleteTimer(old)
        if old != at:
            self.handle.registerTimer(at)
        self.past.update((until, counts, above, at))

    def _closed(self, until: int, silent: int) -> int:
        """When the window that lies so many steps after the last one with mentions has closed."""
        return (until + (silent + 1) * self.step) * 1000

    def _rows(self, alerts: list[tuple]) -> pd.DataFrame:
        names = ["topic", "bucket", "n", "z", "rising"]
        return pd.DataFrame(alerts, columns=names) if self.turns else pd.DataFrame([a[:4] for a in alerts], columns=names[:4])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.past.exists():
            until, counts, above, timer = self.past.get()
            counts = [int(c) for c in counts]
        else:
            until, counts, above, timer = None if self.origin is None else self.origin - self.step, [], False, None
        closed = pd.concat(list(rows)).sort_values("at")  # one row per closed window
        alerts = []
        for at, n in zip(closed["at"].tolist(), closed["n"].tolist()):
            quiet = 0 if until is None else (at - until) // self.step - 1
            if above and quiet and self.turns:
                alerts.append(self._ended(key, until, counts))
            above = above and not quiet
            counts = (counts + [0] * min(quiet, self.history))[-self.history:]
            score = self._score(counts, n)
            if score is not None:
                if score >= self.z and (self.repeat or not above):
                    alerts.append((key[0], pd.Timestamp(at, unit="s"), n, score, True))
                elif self.turns and above and score < self.z:
                    alerts.append((key[0], pd.Timestamp(at, unit="s"), n, score, False))
                above = score >= self.z
            counts = (counts + [n])[-self.history:]
            until = at
        self._set(until, counts, above, self._closed(until, 1 if above else self.forget), timer)
        yield self._rows(alerts)

    def _ended(self, key, until: int, counts: list[int]) -> tuple:
        """The first silent window after a burst."""
        return key[0], pd.Timestamp(until + self.step, unit="s"), 0, self._score(counts, 0), False

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        alerts = []
        if self.past.exists():
            until, counts, above, timer = self.past.get()
            if timer == expiredTimerInfo.getExpiryTimeInMs():
                if above and self.forget > 1:
                    alerts = [self._ended(key, until, [int(c) for c in counts])] if self.turns else []
                    self._set(until, [int(c) for c in counts], False, self._closed(until, self.forget), None)
                else:
                    if above and self.turns:
                        alerts = [self._ended(key, until, [int(c) for c in counts])]
                    self.past.clear()
        yield self._rows(alerts)

    def close(self) -> None:
        pass


def burst_stream(
    counts: DataFrame, width: str, origin: int | None = None, z: float = 3.0, history: int = 7, min_history: int = 3,
    repeat: bool = False, forget: int | None = None, turns: bool = False,
) -> DataFrame:
    """Alerts (topic, bucket, n, z) from `live_counts`, one whenever a topic crosses the cut.

    With `repeat` every window over the cut alerts; with `turns` a column `rising` tells
    crossings of the cut upwards from the windows that end a burst, silent ones included.
    Topics are of any type and keep it. Only closed windows reach the Python processor, a
    row per topic and window, so a viral topic costs it no more than a quiet one.

    `origin` is the start of the first window in seconds since the epoch: quiet windows
    from there on count as zeros; without it a topic's history begins with its first window.
    The state of a topic is its last `history` counts. It goes once the topic has been
    silent for `forget` windows, by default `history` of them: with `origin` that
    changes no alert, as only zeros are forgotten; without it the topic begins anew.
    Needs the RocksDB state store.
    """
    topic = counts.schema["topic"].dataType.simpleString()
    forget = max(forget or history, history if origin is not None else 1)
    closed = counts.select(
        "topic",
        F.unix_timestamp(F.col("window.start")).alias("at"),
        "n",
        F.window_time("window").alias("closes"),
    )
    return closed.groupBy("topic").transformWithStateInPandas(
        statefulProcessor=BurstProcessor(seconds(width), origin, z, history, min_history, repeat, forget, turns),
        outputStructType=alert_schema(topic, turns),
        outputMode="Append",
        timeMode="EventTime",
    )
