"""Small literals: durations given as text ("30 minutes") or seconds, number arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def seconds(duration: str | int) -> int:
    if isinstance(duration, int):
        return duration
    amount, unit = duration.split()
    return int(amount) * _SECONDS[unit.rstrip("s")]


def interval(duration: str | int) -> Column:
    return F.expr(f"make_dt_interval(0, 0, 0, {seconds(duration)})")


def bucket_start(ts, width: str | int) -> Column:
    """Start of the tumbling window that holds `ts`, in the type of `ts`."""
    return F.window(ts, f"{seconds(width)} seconds")["start"]


def number_array(values) -> Column:
    """A sorted array<double> literal, built in one call however long it is."""
    listed = ", ".join(f"{float(v)!r}D" for v in sorted(set(values)))
    return F.expr(f"cast(array({listed}) as array<double>)")
