"""Aggregations; sums and counts are combined before the shuffle by Spark's partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattfleet.functions.quality import route_outcome, valid_cal_point
from wattfleet.functions.scalars import amps, finite_or_zero, watts

SAMPLES = 500
CHANNELS = 6


def window_means(samples: DataFrame, keys: list[str], channel: str = "channel", count: str = "count", divisor: int = SAMPLES) -> DataFrame:
    """Mean count per key and channel over a fixed divisor, with the number of samples there really were."""
    return samples.groupBy(*keys, channel).agg((F.sum(count) / divisor).alias("avg_count"), F.count(count).alias("n_samples"))


def timed_window_means(samples: DataFrame, keys: list[str], at: str, channel: str = "channel", count: str = "count", divisor: int = SAMPLES) -> DataFrame:
    """window_means with duration: from the first to the last sample of the window, over all its channels; at: a number."""
    per = samples.groupBy(*keys, channel).agg((F.sum(count) / divisor).alias("avg_count"), F.count(count).alias("n_samples"), F.min(at).alias("_from"), F.max(at).alias("_to"))
    window = Window.partitionBy(*keys)
    return per.withColumn("duration", F.max("_to").over(window) - F.min("_from").over(window)).drop("_from", "_to")


def calibrated(df: DataFrame, count: str = "avg_count", volts: float | str = 230.0) -> DataFrame:
    """Adds amps and watts to channel rows."""
    return df.withColumn("amps", finite_or_zero(amps(count))).withColumn("watts", watts(volts, "amps"))


def total_watts(df: DataFrame, keys: list[str], value: str = "watts") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("total_watts"))


def delivery_counters(df: DataFrame, keys: list[str], code: str = "http_code") -> DataFrame:
    """sent, rejected, clock_dropped and failed attempts; rejected and clock_dropped are counted by no device."""
    out = route_outcome(code)
    names = {"sent": "sent", "rejected": "rejected", "clock_dropped": "clock_dropped", "failed": "retry"}
    return df.groupBy(*keys).agg(*[F.count_if(out == v).alias(k) for k, v in names.items()], F.count("*").alias("attempts"))


def crash_count(df: DataFrame, key: str, order: list[str], crash: Column, power_on: Column) -> DataFrame:
    """Adds crash_count after each boot: one more for a crash, 0 at power-on, else as before."""
    w = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("_since", F.count_if(power_on).over(w))
    return df.withColumn("crash_count", F.count_if(crash).over(Window.partitionBy(key, "_since").orderBy(*order))).drop("_since")


def heap_low_water(df: DataFrame, keys: list[str], order: list[str], free: str) -> DataFrame:
    """Adds the least free heap since boot; keys hold the device and its boot."""
    return df.withColumn("min_heap", F.min(free).over(Window.partitionBy(*keys).orderBy(*order)))


def offline_rollup(blocks: DataFrame, key: str = "path", readings: str = "readings", raw: str = "raw_bytes", size: str = "data_bytes") -> DataFrame:
    """Readings, blocks, file bytes (a header of 40, then 2 and the data per block) and compression ratio of each file."""
    return blocks.groupBy(key).agg(
        F.sum(readings).alias("readings"), F.count("*").alias("blocks"), (F.sum(F.col(size) + 2) + 40).alias("file_bytes"), (F.sum(raw) / F.greatest(F.sum(size), F.lit(1))).alias("ratio")
    )


def counter_increase(df: DataFrame, key: str, order: list[str], counter: str, uptime: str) -> DataFrame:
    """Adds how much a counter grew since the row before; after a reboot (uptime fell) that is its value."""
    w = Window.partitionBy(key).orderBy(*order)
    reset = F.lag(uptime).over(w).isNull() | (F.col(uptime) < F.lag(uptime).over(w))
    return df.withColumn("increase", F.when(reset, F.col(counter)).otherwise(F.col(counter) - F.lag(counter).over(w)))


def health_report(df: DataFrame, key: str, ts: str, every: str, values: list[str], tie: str | None = None) -> DataFrame:
    """The last values in each tumbling window."""
    last = F.struct(ts, tie) if tie else F.col(ts)
    out = df.groupBy(F.window(ts, every).alias("_w"), key).agg(*[F.max_by(v, last).alias(v) for v in values], F.count("*").alias("reports"))
    return out.select(F.col("_w.start").alias("window_start"), key, *values, "reports")


def calibration_points(df: DataFrame, channel: str, point: str, value: str, order: str, keys: tuple[str, ...] = (), group: int = SAMPLES) -> DataFrame:
    """The mean of the last recording of every calibration point in range, of all before `order` in the same run of `group`."""
    good = df.filter(valid_cal_point(channel, point))
    runs = good.groupBy(*keys, channel, point, F.floor(F.col(order) / group).alias("_run")).agg(F.avg(value).alias("_mean"), F.max(order).alias("_at"), F.count("*").alias("_n"))
    return runs.groupBy(*keys, channel, point).agg(F.max_by("_mean", "_at").alias("mean_value"), F.max("_at").alias("recorded_at"), F.max_by("_n", "_at").alias("n_samples"))


def device_status(readings: DataFrame, key: str, order: list[str], channel: str = "channel", value: str = "value") -> DataFrame:
    """One row per device: its newest reading's order, number of readings, total, and the latest value of every channel."""
    last = F.struct(*order)
    per = [F.max_by(F.when(F.col(channel) == c, F.col(value)), F.when(F.col(channel) == c, last)).alias(f"ct_{c}") for c in range(1, CHANNELS + 1)]
    return readings.groupBy(key).agg(F.max(order[0]).alias("last_seen"), F.count("*").alias("readings"), F.sum(value).alias("total"), *per)


def device_report(readings: DataFrame, heartbeats: DataFrame, key: str, order: list[str], fields: list[str], channel: str = "channel") -> DataFrame:
    """One row per device: `fields` of its newest heartbeat, amps and watts of every channel's newest reading, and their total.

    readings: key, order, channel, amps, watts; heartbeats: key, order, fields (firmware, signal,
    queue depth, counters). Devices without readings or without heartbeats have nulls there; a
    channel without a reading adds nothing to the total.
    """
    last = F.struct(*order)
    newest = {c: F.max_by(F.struct("amps", "watts"), F.when(F.col(channel) == c, last)).alias(f"_{c}") for c in range(1, CHANNELS + 1)}
    power = readings.groupBy(key).agg(F.max(order[0]).alias("last_reading"), *newest.values())
    parts = {f"ct_{c}_{v}": F.col(f"_{c}.{v}") for c in newest for v in ("amps", "watts")}
    total = sum((F.coalesce(f"_{c}.watts", F.lit(0.0)) for c in newest), F.lit(0.0))
    power = power.select(key, "last_reading", *[x.alias(n) for n, x in parts.items()], total.alias("total_watts"))
    beats = heartbeats.groupBy(key).agg(F.max(order[0]).alias("last_heartbeat"), F.max_by(F.struct(*fields), last).alias("_beat")).select(key, "last_heartbeat", "_beat.*")
    return power.join(beats, key, "full")
