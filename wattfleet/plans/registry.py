"""Queries over the driver's tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: HTTP code that an event type plays.
CODES = {"click": 200, "view": 200, "signup": 400, "purchase": 422, "error": 500}
CODE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CODES.items()) + " END"
#: Boot reason that an event type plays.
REASONS = {"click": "sw", "view": "deepsleep", "signup": "panic", "purchase": "poweron", "error": "brownout"}
REASON_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REASONS.items()) + " END"
ORDER = ["ts", "event_id"]


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def code() -> Column:
    return F.expr(CODE_SQL)


def reason() -> Column:
    return F.expr(REASON_SQL)


def channel() -> Column:
    return (F.col("event_id") % 6 + 1).cast("int")


def micros(c: str = "ts") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def scratch(spark) -> str:
    """A new folder that driver and executors share; with a local master one is made if spark.checkpoint.dir is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{uuid.uuid4().hex}"
