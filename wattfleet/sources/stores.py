"""Folders that several jobs write to: what each of them adds holds once, however often it is repeated.

Everything goes through Spark's writers and Hadoop's file systems, so that a path may lie in any
store that Spark can use.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes df by partition; of what is there only the partitions that df has are replaced, all at once when the job ends."""
    df.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern."""
    fs, p = _fs(spark, pattern)
    return [s.getPath().toString() for s in fs.globStatus(p) or []]


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_small(spark: SparkSession, path: str) -> str:
    """A file of one short line."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.hadoop.io.Text.decode(bytearray(stream.readAllBytes())).strip()
    finally:
        stream.close()


def replace_small(spark: SparkSession, path: str, text: str) -> None:
    """Puts a short line in the place of a file by one rename: readers find the old line or the new one."""
    jvm, (fs, p) = spark._jvm, _fs(spark, path)
    fs, new = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    where = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    where.rename(fs.makeQualified(new), fs.makeQualified(p), options)


POINTER = "CURRENT"


def publish_snapshot(df: DataFrame, path: str, keep: int = 2) -> str:
    """Writes df as a new version of the table and makes it the current one; the version's name.

    The rows go to a folder of their own; then the pointer is replaced by one rename. A reader
    resolves the pointer once and so sees the old table or the new one, whole; a write that fails
    leaves the old one. The `keep` newest versions stay for readers that resolved before.
    """
    spark = df.sparkSession
    number = 1 + max((int(n[2:12]) for n in children(spark, path) if n.startswith("v-")), default=0)
    version = f"v-{number:010d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    replace_small(spark, f"{path}/{POINTER}", version)
    for old in [n for n in children(spark, path) if n.startswith("v-") and n <= version][:-keep]:
        delete(spark, f"{path}/{old}")
    return version


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a published table."""
    return spark.read.parquet(f"{path}/{read_small(spark, f'{path}/{POINTER}')}")


def write_dead_letters(df: DataFrame, path: str, key: str, order: str, text: str, batch: int, cap: int = 50_000) -> None:
    """Appends a batch to logs with a size cap, one log for each key: what comes before a log has reached the cap is taken, the rest is not.

    The bytes that a batch adds to each log are kept beside them and are where the next batch
    starts. Batches are numbered upwards; a batch that is repeated replaces what it wrote before. A
    null key has a log as well; null texts are empty lines.
    """
    from wattfleet.functions.quality import dead_letter

    spark, sizes = df.sparkSession, f"{path}/sizes"
    start = None
    if exists(spark, sizes):
        kind = df.schema[key].dataType.simpleString()
        before = spark.read.schema(f"`{key}` {kind}, bytes long, batch int").parquet(sizes).filter(F.col("batch") < batch)
        start = before.groupBy(key).agg(F.max("bytes").alias("bytes"))
    taken = dead_letter(df, key, order, text, cap, start).withColumn("batch", F.lit(batch))
    overwrite_partitions(taken, f"{path}/log", "batch")
    mine = spark.read.schema(taken.schema).parquet(f"{path}/log").filter(F.col("batch") == batch)
    grown = mine.groupBy(key).agg(F.max(F.col("bytes_before") + F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 2).alias("bytes"))
    overwrite_partitions(grown.withColumn("batch", F.lit(batch)), sizes, "batch")


def write_sides(df: DataFrame, path: str, side: str, batch: int = 0) -> None:
    """Rows and those set apart from them in one pass: the column `side` becomes a folder, so that readers of one side see no file of the other."""
    overwrite_partitions(df.withColumn("batch", F.lit(batch)), path, side, "batch")


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/log").drop("batch")


def upsert_calibration(samples: DataFrame, path: str, channel: str, point: str, value: str, order: str, keys: tuple[str, ...] = (), group: int = 500, buckets: int = 16) -> None:
    """Merges an increment of samples into stored calibration points.

    A stored point holds the sums of its last recording, a run of `group` by `order`, so increments
    may come in any order and may cut a recording in two: of a later recording the sums replace, of
    the same one they add up, of an earlier one they are left. Points lie in buckets by a hash of
    their keys; only the buckets that an increment touches are read and written. No increment may
    come twice.
    """
    from wattfleet.functions.quality import valid_cal_point

    spark, by = samples.sparkSession, [*keys, channel, point]
    runs = samples.filter(valid_cal_point(channel, point)).groupBy(*by, F.floor(F.col(order) / group).alias("run")).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.max(order).alias("recorded_at"))
    runs = runs.withColumn("bucket", F.pmod(F.hash(*by), F.lit(buckets)))
    if exists(spark, path):
        # at most `buckets` numbers; as a literal they prune the folders that are read
        touched = [r.bucket for r in runs.select("bucket").distinct().collect()]
        runs = spark.read.schema(runs.schema).parquet(path).filter(F.col("bucket").isin(touched)).unionByName(runs)
    merged = runs.groupBy("bucket", *by, "run").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("recorded_at").alias("recorded_at"))
    last = merged.groupBy("bucket", *by).agg(F.max_by(F.struct("run", "total", "n", "recorded_at"), "run").alias("_l"))
    overwrite_partitions(last.select(*by, "_l.*", "bucket"), path, "bucket")


def read_calibration(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """by, mean_value, recorded_at, n_samples, as aggregates.calibration_points has them."""
    return spark.read.parquet(path).select(*by, (F.col("total") / F.col("n")).alias("mean_value"), "recorded_at", F.col("n").alias("n_samples"))
