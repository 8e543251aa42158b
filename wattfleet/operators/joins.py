"""Joins: enrichment by dimension, as of a time, by range, and against an expected grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattfleet.functions.scalars import semver

#: The pin of each channel.
PINS = {1: 36, 2: 39, 3: 34, 4: 35, 5: 32, 6: 33}


def enrich(readings: DataFrame, config: DataFrame, key: str) -> DataFrame:
    """Adds a device's attributes. Spark broadcasts config if its size allows, else both sides are shuffled."""
    return readings.join(config, key, "left")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], tie: str) -> DataFrame:
    """left with the values of the last row of right at or before it, by key; one sort of both, no range join.

    Of right's rows at the same time the one with the largest tie counts.
    """
    packed = F.struct(F.col(ts).alias("_at"), *[F.col(v) for v in values])
    both = left.withColumns({"_right": F.lit(None).cast(right.select(packed.alias("p")).schema[0].dataType), "_side": F.lit(1), "_tie": F.lit(None).cast(right.schema[tie].dataType)}).unionByName(
        right.select(key, ts, packed.alias("_right"), F.lit(0).alias("_side"), F.col(tie).alias("_tie")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(ts, "_side", "_tie")
    out = both.withColumn("_last", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(*left.columns, F.col("_last._at").alias("as_of"), *[F.col(f"_last.{v}").alias(v) for v in values])


def enrich_as_of(readings: DataFrame, boots: DataFrame, config: DataFrame, key: str, ts: str, values: list[str], tie: str) -> DataFrame:
    """The configuration in force: the last written at or before the last boot at or before the reading.

    boots: key, ts; config: key, ts, tie, values; both name their time `ts`.
    """
    at_boot = as_of(boots.select(key, ts), config, key, ts, values, tie).withColumnRenamed("as_of", "config_at")
    at_boot = at_boot.withColumn("_n", F.lit(0))
    return as_of(readings, at_boot, key, ts, ["config_at", *values], "_n").withColumnRenamed("as_of", "booted_at")


def with_channel_dim(df: DataFrame, channel: str = "channel") -> DataFrame:
    """Adds the channel's pin, from six constant rows."""
    dim = df.sparkSession.createDataFrame(list(PINS.items()), f"{channel} int, pin int")
    return df.withColumn(channel, F.col(channel).cast("int")).join(F.broadcast(dim), channel, "left")


def best_offer(checks: DataFrame, releases: DataFrame, current: str, version: str, keys: list[str]) -> DataFrame:
    """For each check row the greatest release above its version; none: no row.

    Releases are first reduced to one row per line (keys), since only the greatest can be best: the
    join has one release per check, whatever the length of the catalogue.
    """
    on = keys or ["_line"]
    if not keys:  # one line for all
        checks, releases = checks.withColumn("_line", F.lit(1)), releases.withColumn("_line", F.lit(1))
    best = releases.groupBy(*on).agg(F.max_by(version, semver(version)).alias("_best"))
    joined = checks.join(best, on).drop("_line")
    return joined.filter(semver("_best") > semver(current)).withColumnRenamed("_best", "offered")


def missed_slots(df: DataFrame, key: str, day: str) -> DataFrame:
    """Days between a key's first and last row on which it has none: between neighbours, so that each row yields only what is missing after it."""
    seen = df.select(key, day).distinct()
    nxt = seen.withColumn("_next", F.lead(day).over(Window.partitionBy(key).orderBy(day)))
    return nxt.filter(F.datediff("_next", day) > 1).select(key, F.explode(F.sequence(F.date_add(day, 1), F.date_sub("_next", 1))).alias("missed"))


def missed_intervals(df: DataFrame, key: str, ts: str, every_s: int) -> DataFrame:
    """Slots of every_s seconds (counted from the epoch) between a key's first and last row in which it has none: their starts, in seconds."""
    seen = df.select(key, F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / every_s).alias("_slot")).distinct()
    nxt = seen.withColumn("_next", F.lead("_slot").over(Window.partitionBy(key).orderBy("_slot")))
    return nxt.filter(F.col("_next") - F.col("_slot") > 1).select(key, F.explode(F.transform(F.sequence(F.col("_slot") + 1, F.col("_next") - 1), lambda s: s * every_s)).alias("missed_at"))


def command_effects(commands: DataFrame, writes: DataFrame, keys: list[str], ts: str, within_s: int) -> DataFrame:
    """Commands with the first write of the same setting that follows within a time; writes: keys, ts, value."""
    write = F.struct(F.col(ts).alias("at"), F.col("value").alias("value"))
    none = F.lit(None).cast(writes.select(write.alias("w")).schema[0].dataType)
    both = commands.withColumns({"_write": none, "_side": F.lit(0)}).unionByName(writes.select(*keys, ts, write.alias("_write"), F.lit(1).alias("_side")), allowMissingColumns=True)
    # from the last to the first, the write seen last is the one that follows; one sort, no pairs
    back = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc("_side"), F.desc("_write"))
    hit = both.withColumn("_next", F.last("_write", ignorenulls=True).over(back)).filter("_side = 0")
    hit = hit.filter(F.expr(f"_next.at <= {ts} + INTERVAL {int(within_s)} SECONDS"))
    return hit.select(*commands.columns, F.col("_next.at").alias("effect_at"), F.col("_next.value").alias("effect_value"))
