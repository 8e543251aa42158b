"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII takes Spark's short way."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. With a local master, where all run in one process, one is made if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, so that a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote, once all that was made of them is written too."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._saved_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Caches of what is large in a Python worker, and the stage that filled them last.
_HELD: list = []
_stage: list[int | None] = [None]


def held_for_stage(make: Callable) -> Callable:
    """Caches what make() gives in a Python worker, until a task of another stage begins with memory_returned()."""
    _HELD.append(lru_cache(maxsize=2)(make))
    return _HELD[-1]


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's call that gives free memory back, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def return_memory() -> None:
    """Gives the memory that Arrow and the C library keep for later back to the system; where stages changed, the held caches too."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _stage[0]:
        _stage[0] = stage
        for x in _HELD:
            x.cache_clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def memory_returned(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with the worker's free memory given back before and after each task.

    Spark uses workers again, and an executor has more of them than cores once a stage has had two
    Python steps; without this each keeps the most that any of its tasks has needed.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_memory()
        yield from run(batches)
        return_memory()

    return task
