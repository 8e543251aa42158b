"""Running sums per key over a table of any size: no key has to fit into one task.

Rows are dealt out by ranges of (key, order), so that a key with very many rows spans several
partitions. Each partition sums up by itself; then what came before it is added, from one row for
each partition that a spanning key touches.

A term is a plain sum, or a polynomial one modulo a prime, whose i-th row counts x^i times. Such
sums are a monoid: the sum over a stretch a and then b is sum(a) + x^len(a) * sum(b).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattfleet.llm.common import saved

#: Column to (x, p), or to None for a plain sum.
Terms = dict[str, tuple[int, int] | None]


def powers(x: int, p: int, n: int) -> np.ndarray:
    """x^0 .. x^(n-1) modulo p, for p below 2^31."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(x, len(out), p) % p])
    return out[:n]


def running(rows: DataFrame, key: str, order: list, terms: Terms) -> DataFrame:
    """rows with position (from 0 in its key) and, for every term, <name>_run: the sum up to and with this row.

    key and terms are integers and not null, terms of primes lie in 0 .. p - 1. The partitions' own
    sums are written to the shared folder.
    """
    names, k = rows.columns, rows.columns.index(key)
    at = [names.index(c) for c in terms]
    added = ["_part", "position", *[f"{c}_run" for c in terms]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, count, sums = None, 0, [0] * len(at)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(k).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            if keys[0] != last:
                count, sums = 0, [0] * len(at)
            place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            out = []
            for i, (c, term) in enumerate(zip(at, terms.values())):
                v = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                if term:
                    x, p = term
                    v = v * powers(x, p, n)[place] % p
                    if count:
                        end = starts[1] if len(starts) > 1 else n
                        v[:end] = v[:end] * pow(x, count, p) % p
                total = np.cumsum(v)
                before = np.concatenate([[0], total])[starts]
                before[0] -= sums[i]
                total = total - np.repeat(before, np.diff(np.append(starts, n)))
                total = total % term[1] if term else total
                sums[i] = int(total[-1])
                out.append(pa.array(total, pa.int64()))
            place[: starts[1] if len(starts) > 1 else n] += count
            last, count = keys[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(place, pa.int64()), *out], [*names, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_part int, position long", *(f"`{c}_run` long" for c in terms)])
    local = saved(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(run, schema), "scan")
    return carried(local, key, terms)


def carried(local: DataFrame, key: str, terms: Terms) -> DataFrame:
    """Adds what came before a partition. Both broadcasts have at most two rows for each partition of `local`."""
    edges = local.groupBy("_part").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    spanning = edges.select("_part", F.explode(F.array_distinct(F.array("a", "b"))).alias(key)).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
    last = F.max_by(F.struct("position", *[f"{c}_run" for c in terms]), "position").alias("t")
    totals = local.join(F.broadcast(spanning), key, "left_semi").groupBy(key, "_part").agg(last).select(key, "_part", (F.col("t.position") + 1).alias("_n"), *[F.col(f"t.{c}_run").alias(f"_{c}") for c in terms])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    primes = {c: t for c, t in terms.items() if t}

    def shifts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(batch.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([pow(x, b, p) for b in before], pa.int64()) for x, p in primes.values())], [*batch.schema.names, *(f"_{c}_by" for c in primes)])

    if primes:
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in totals.schema), *(f"`_{c}_by` long" for c in primes)])
        totals = totals.mapInArrow(shifts, schema)
    carry = totals.select(key, "_part", "_before", *[f"_{c}_by" for c in primes], *[F.coalesce(F.sum(F.col(f"_{c}") * F.col(f"_{c}_by") % primes[c][1] if c in primes else F.col(f"_{c}")).over(earlier), F.lit(0)).alias(f"_{c}") for c in terms])
    out = local.join(F.broadcast(carry), [key, "_part"], "left")
    for c, t in terms.items():
        now = F.col(f"{c}_run") * F.coalesce(f"_{c}_by", F.lit(1)) if t else F.col(f"{c}_run")
        total = F.coalesce(f"_{c}", F.lit(0)) + now
        out = out.withColumn(f"{c}_run", total % t[1] if t else total)
    return out.withColumn("position", F.col("position") + F.coalesce("_before", F.lit(0))).select([c for c in local.columns if c != "_part"])
