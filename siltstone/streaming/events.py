"""Event streams: the same functions take a batch table or a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, keys: Sequence[str], values: dict[str, Column], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, keys and the aggregates of each tumbling window (sliding, with slide). `late`: the watermark of a stream."""
    if late:
        events = events.withWatermark(ts, late)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = events.groupBy(w.alias("_w"), *keys).agg(*[c.alias(k) for k, c in values.items()])
    return g.select(F.col("_w.start").alias("window_start"), *keys, *values)


def sessions(events: DataFrame, ts: str, keys: Sequence[str], values: dict[str, Column], gap: str, late: str | None = None) -> DataFrame:
    """session_start, keys and the aggregates of runs of events that lie less than `gap` apart."""
    if late:
        events = events.withWatermark(ts, late)
    g = events.groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(*[c.alias(k) for k, c in values.items()])
    return g.select(F.col("_w.start").alias("session_start"), *keys, *values)


def first_within(events: DataFrame, ts: str, keys: Sequence[str], late: str) -> DataFrame:
    """Of a stream's events with equal keys just the first within the watermark's delay."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def unexpired(events: DataFrame, ts: str, kind: str, days: dict[str, int], default_days: int, now: Column) -> DataFrame:
    """Events whose time to live, by kind, isn't over."""
    ttl = F.coalesce(*[F.when(F.col(kind) == k, F.lit(d)) for k, d in days.items()], F.lit(default_days))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 86_400_000_000
    return events.where(age <= ttl)
