"""Streaming forms: latest by key, de-duplication, sessions and late data; state machines are in event_time.

Each has a batch counterpart with the same result; tests run the stream with availableNow and compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, on a batch or (output mode update or complete) on a stream; state is one row per key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(key, "_last.*")


def dedupe_stream(df: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """One row per key within the delay; state older than the watermark is dropped."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def live_totals(df: DataFrame, ts: str, delay: str, every: str, key: str, value: str) -> DataFrame:
    """Sums per key and tumbling window, with a watermark as short as live rows need."""
    out = df.withWatermark(ts, delay).groupBy(F.window(ts, every).alias("_w"), key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return out.select(F.col("_w.start").alias("window_start"), key, "total", "n")


def restate(live: DataFrame, everything: DataFrame, late: DataFrame, day: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Daily results with the days that late rows touch computed anew from all rows; other days stay as they were.

    live: results so far; everything: all rows with `day`; build makes results with `day` from rows.
    With rows stored by day only the touched partitions are read.
    """
    touched = late.select(day).distinct()
    return live.join(touched, day, "left_anti").unionByName(build(everything.join(touched, day, "left_semi")))


def silent_devices(df: DataFrame, key: str, ts: str, gap: str, least: int = 1) -> DataFrame:
    """Stretches of reports without a gap: start, end, reports; a device is silent between them."""
    out = df.groupBy(F.session_window(ts, gap).alias("_s"), key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("reports"))
    return out.filter(F.col("reports") >= least).select(key, "first_seen", "last_seen", "reports")
