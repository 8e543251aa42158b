"""Rows that come late on a live stream: set apart, and their days stated anew.

Micro-batches are stored by day and batch. The watermark is the latest time that earlier batches
held, less the delay; it is kept beside the rows, so that a restart goes on from it. A day is
stated once the watermark has passed it; a late row's day is stated again, from all of its rows.
Other days' files stay as they are. A micro-batch that is repeated replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from wattfleet.sources.stores import children, matches, overwrite_partitions, read_small, replace_small

DAY_US = 86_400_000_000


class LateRows:
    """A store of rows under `path`, with the columns of its stream, whose results by day come from build(rows with day).

    rows/: all rows by day and batch, with whether they came late; late/: those that did, by batch; daily/: results
    by day; progress/: the watermark after each batch, in microseconds. at: the time column, in
    microseconds; rows without a time are set apart as late and belong to no day.
    """

    def __init__(self, path: str, at: str, delay_us: int, build: Callable[[DataFrame], DataFrame]):
        self.path, self.at, self.delay_us, self.build = path, at, delay_us, build

    def watermark(self, spark: SparkSession, before: int) -> int | None:
        """After all batches before this one; batches that had no row are passed over."""
        done = [int(n) for n in children(spark, f"{self.path}/progress") if n.isdigit() and int(n) < before]
        return int(read_small(spark, f"{self.path}/progress/{max(done)}")) if done else None

    def day(self):
        return F.floor(F.col(self.at) / DAY_US)

    def stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def state(self, rows: DataFrame) -> None:
        """States the days of these rows."""
        overwrite_partitions(self.build(rows.drop("batch", "late")), f"{self.path}/daily", "day")

    def add(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch."""
        spark = rows.sparkSession
        before = self.watermark(spark, batch)
        behind = F.col(self.at).isNull() if before is None else F.coalesce(F.col(self.at) < before, F.lit(True))
        marked = rows.withColumns({"late": behind, "day": self.day(), "batch": F.lit(batch)})
        overwrite_partitions(marked, f"{self.path}/rows", "day", "batch")
        written = matches(spark, f"{self.path}/rows/day=*/batch={batch}")
        if not written:
            return
        mine = spark.read.schema(marked.schema).option("basePath", f"{self.path}/rows").parquet(*written)
        late = mine.filter("late").drop("late")
        overwrite_partitions(late, f"{self.path}/late", "batch")
        newest = mine.agg(F.max(self.at)).first()[0]
        if newest is None:
            return
        after = newest - self.delay_us if before is None else max(before, newest - self.delay_us)
        closed, closing = (0 if before is None else before // DAY_US), after // DAY_US
        # the days of late rows, a list no longer than the calendar; as literals they prune the folders that are read
        again = [] if before is None else [r.day for r in late.filter(F.col("day") < closed).select("day").distinct().collect()]
        passed = (F.col("day") < closing) if before is None else ((F.col("day") >= closed) & (F.col("day") < closing))
        self.state(self.stored(spark).filter(passed | F.col("day").isin(again)))
        replace_small(spark, f"{self.path}/progress/{batch}", str(after))

    def finish(self, spark: SparkSession) -> None:
        """States the days that the watermark hasn't passed yet, of which more rows may come; later batches state them again."""
        now = self.watermark(spark, 1 << 62)
        if now is not None:
            self.state(self.stored(spark).filter(F.col("day") >= now // DAY_US))

    def writer(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)

    def daily(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/daily")

    def late(self, spark: SparkSession) -> DataFrame:
        """The rows set apart."""
        return spark.read.parquet(f"{self.path}/late")


def write_readings_stream(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts") -> DataStreamWriter:
    """Readings by date, each once: a micro-batch has folders of its own, and one that is repeated replaces them."""
    return stream.writeStream.foreachBatch(lambda rows, batch: write_readings_batch(rows, batch, path, ts)).option("checkpointLocation", checkpoint)


def write_readings_batch(rows: DataFrame, batch: int, path: str, ts: str = "ts") -> None:
    rows = rows.withColumns({"date": F.to_date(ts), "batch": F.lit(batch)}).hint("rebalance", "date")
    overwrite_partitions(rows, path, "date", "batch")
