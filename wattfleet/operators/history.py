"""One history per device out of live, saved and offline readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Origins from the most to the least trusted.
ORIGINS = ["live", "saved", "offline"]


def merge_readings(live: DataFrame, saved: DataFrame, offline: DataFrame) -> DataFrame:
    """All readings with origin and ts_quality (exact or estimated); offline rows know amps only, their watts are rebuilt."""
    parts = [
        live.withColumns({"origin": F.lit("live"), "ts_quality": F.lit("exact")}),
        saved.withColumns({"origin": F.lit("saved"), "ts_quality": F.lit("exact")}),
        offline.withColumns({"origin": F.lit("offline"), "ts_quality": F.lit("estimated")}),
    ]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    if {"amps", "voltage", "watts"} <= set(out.columns):
        out = out.withColumn("watts", F.coalesce("watts", F.col("voltage") * F.col("amps") * 0.9))
    return out


def dedupe_readings(df: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """One row per key: the most trusted origin, then the smallest tie. Aggregated before the shuffle, so a hot key is one row per task."""
    rank = F.array_position(F.array(*map(F.lit, ORIGINS)), F.col("origin"))
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank.alias("r"), *tie)).alias("_row"), F.count("*").alias("deliveries"))
    return out.select(*keys, "_row.*", "deliveries")


def dedupe_errors(df: DataFrame, keys: list[str], received: str) -> DataFrame:
    """Errors that were sent more than once: first received, and how often."""
    return df.groupBy(*keys).agg(F.min(received).alias("first_received"), F.count("*").alias("times"))
