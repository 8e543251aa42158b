"""The plain sink of readings; stores that are written to again and again are in sources.stores, the stream's in streaming.late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_readings(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends readings by date; rows of a date are gathered first, so that each has few files, but a large one is split over tasks."""
    df.withColumn("date", F.to_date(ts)).hint("rebalance", "date").write.partitionBy("date").mode("append").parquet(path)
