"""Sequence semantics per device: frames and islands as window functions, recurrences as a fold.

Everything is keyed, so chained window operators on one key share a shuffle. A fold is dealt out by
its key anew, then streams over rows sorted by key and order with constant state: no group is ever held in memory, and a device with
very many rows is a long run of rows, not a large object.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattfleet.functions.scalars import backoff_ms


def ordered(key: str | list[str], order: list[str], desc: bool = False):
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) if desc else F.asc(c) for c in order])


def rolling_signal(df: DataFrame, key: str, order: list[str], value: str, n: int = 60) -> DataFrame:
    """Adds rolling_min (never above 0) and rolling_avg (towards zero) of the last n rows."""
    w = ordered(key, order).rowsBetween(1 - n, 0)
    total, count = F.sum(F.col(value).cast("long")).over(w), F.count(value).over(w)
    return df.withColumns({"rolling_min": F.least(F.lit(0), F.min(value).over(w)), "rolling_avg": F.when(count > 0, (total - F.pmod(F.abs(total), count) * F.signum(total).cast("long")) / count).cast("long")})


def newest(df: DataFrame, key: str, order: list[str], n: int = 30) -> DataFrame:
    """The n newest rows of each key, with their rank; Spark drops all others before the shuffle."""
    return df.withColumn("newest", F.row_number().over(ordered(key, order, desc=True))).filter(F.col("newest") <= n)


def keep_latest(df: DataFrame, key: str, order: list[str], n: int = 30) -> DataFrame:
    """The n newest rows of each key, each with how many older ones were displaced; the count has partial sums of its own."""
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("displaced"))
    out = newest(df, key, order, n)
    return out.join(counts, out[key].eqNullSafe(F.col("_key"))).drop("_key")


def first_n(df: DataFrame, key: str | list[str], order: list[str], n: int) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(ordered(key, order))).filter(F.col("nth") <= n)


def every_nth(df: DataFrame, key: str, order: list[str], n: int = 10) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(ordered(key, order))).filter(F.col("nth") % n == 0)


def pack_blocks(df: DataFrame, key: str, order: list[str], fields: list[str], n: int = 10) -> DataFrame:
    """Consecutive rows in blocks of n, the last of a key shorter: key, block, n_rows, rows (structs in order)."""
    pos = df.withColumn("_pos", F.row_number().over(ordered(key, order)) - 1)
    out = pos.withColumn("block", F.floor(F.col("_pos") / n)).groupBy(key, "block").agg(F.sort_array(F.collect_list(F.struct("_pos", *fields))).alias("rows"))
    return out.select(key, "block", F.size("rows").alias("n_rows"), F.transform("rows", lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias("rows"))


def oldest_first(df: DataFrame, key: str, order: list[str], fields: list[str], n: int = 30) -> DataFrame:
    """Replay of each key's n newest rows, oldest first, as one array; n bounds it."""
    return newest(df, key, order, n).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, *[F.col(f).alias(f"_{f}") for f in fields]))), lambda r: F.struct(*[r[f"_{f}"].alias(f) for f in fields])).alias("rows"))


def failure_runs(df: DataFrame, key: str, order: list[str], fail: Column, reset: Column) -> DataFrame:
    """Adds run (failures in a row up to here, reset by a success) and first_of_run."""
    df = df.withColumns({"_fail": F.coalesce(fail, F.lit(False)), "_island": F.count_if(reset).over(ordered(key, order))})
    run = F.count_if("_fail").over(ordered([key, "_island"], order))
    return df.withColumn("run", run).withColumn("first_of_run", F.col("_fail") & (F.col("run") == 1)).drop("_island", "_fail")


def with_backoff(runs: DataFrame) -> DataFrame:
    return runs.withColumn("backoff_ms", F.when(F.col("run") > 0, backoff_ms("run")).otherwise(1000))


def stalls(runs: DataFrame, fail: Column, n: int = 5) -> DataFrame:
    """The failure that makes a run n long: one mark per run."""
    return runs.filter(fail & (F.col("run") == n))


def edges(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Rows where a connection goes down or comes up; before the first row it is down."""
    df = df.withColumn("_flag", flag)
    out = df.withColumn("_was", F.coalesce(F.lag("_flag").over(ordered(key, order)), F.lit(False))).filter(F.col("_flag") != F.col("_was"))
    return out.withColumn("edge", F.when(F.col("_flag"), "up").otherwise("down")).drop("_flag", "_was")


def outages(df: DataFrame, key: str, ts: str, order: list[str], flag: Column, grace_s: float = 30) -> DataFrame:
    """Stretches of rows without connection: start, end (the row that is connected again, null if none), duration_s, beyond_grace."""
    w = ordered(key, order)
    df = df.withColumns({"_flag": flag, "_ups": F.count_if(flag).over(w)})
    # a stretch is the rows after one connected row, ended by the next
    down = df.filter(~F.col("_flag")).groupBy(key, "_ups").agg(F.min(ts).alias("outage_start"), F.count("*").alias("rows"))
    up = df.filter("_flag").select(key, (F.col("_ups") - 1).alias("_ups"), F.col(ts).alias("outage_end"))
    out = down.join(up, [key, "_ups"], "left").drop("_ups")
    seconds = (F.unix_micros(F.col("outage_end").cast("timestamp")) - F.unix_micros(F.col("outage_start").cast("timestamp"))) / 1e6
    return out.withColumn("duration_s", seconds).withColumn("beyond_grace", F.coalesce(F.col("duration_s") > grace_s, F.lit(False)))


def retry_cycles(df: DataFrame, key: str, order: list[str], scheduled: Column, failed: Column, retries: int = 3) -> DataFrame:
    """Attempts by check cycle: each scheduled check starts one; retry numbers its failed attempts, exhausted marks the last allowed."""
    df = df.withColumns({"_failed": failed, "cycle": F.count_if(scheduled).over(ordered(key, order))}).filter("_failed AND cycle > 0")
    out = df.withColumn("retry", F.row_number().over(ordered([key, "cycle"], order)))
    return out.withColumn("exhausted", F.col("retry") == retries).filter(F.col("retry") <= retries).drop("_failed")


def upload_sessions(df: DataFrame, key: str, order: list[str], ts: str, terminal: Column) -> DataFrame:
    """Attempts up to and with the one that ends the upload: attempts, start, end, finished."""
    before = F.count_if(terminal).over(ordered(key, order).rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumns({"session": F.coalesce(before, F.lit(0)), "_end": terminal})
    return df.groupBy(key, "session").agg(F.count("*").alias("attempts"), F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.bool_or("_end").alias("finished"))


def fold(df: DataFrame, key: str, order: list[str], inputs: list[str], start: Callable[[], object], step: Callable, outputs: str) -> DataFrame:
    """df with the columns `outputs` that step(state, *inputs) -> (state, values) gives row by row, per key in order."""
    added = [part.split()[0] for part in outputs.split(",")]
    df = df.drop(*added)
    names, at = df.columns, [df.columns.index(c) for c in inputs]
    k = names.index(key)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, first = None, None, True
        for batch in batches:
            values: list[list] = [[] for _ in added]
            for device, *x in zip(batch.column(k).to_pylist(), *(batch.column(i).to_pylist() for i in at)):
                if first or device != last:
                    last, state, first = device, start(), False
                state, new = step(state, *x)
                for c, v in zip(values, new):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip(values, types))], [*names, *added])

    simple = {"boolean": pa.bool_(), "bool": pa.bool_(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    types = [simple[part.split()[1].lower()] for part in outputs.split(",")]
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def throttle(df: DataFrame, key: str, order: list[str], at: str, gap: int, anchor: int | None = None) -> DataFrame:
    """Adds kept: a row is kept if at least `gap` lies between it and the last kept one (or the anchor, if none was)."""

    def step(last, now):
        keep = last is None or now - last >= gap
        return (now if keep else last), (keep,)

    return fold(df, key, order, [at], lambda: anchor, step, "kept boolean")


def phase_step(interval: int) -> Callable:
    """The step of phase_slots on (last slot,)."""

    def step(state, now):
        (last,) = state
        if now - last < interval:
            return state, (None, False)
        slot = last + interval
        late = now - slot > interval
        slot = int(now if late else slot)
        return (slot,), (slot, late)

    return step


def phase_slots(df: DataFrame, key: str, order: list[str], at: str, interval: int, start: int = 0) -> DataFrame:
    """Adds slot (null if none is due) and resynced: slots keep their phase until one is more than an interval late."""

    return fold(df, key, order, [at], lambda: (start,), phase_step(interval), "slot long, resynced boolean")


def stability_step(limit: int) -> Callable:
    """The step of update_stability on (fresh, crashes): an update is fresh and starts counting crashes anew."""

    def step(state, is_update, is_crash):
        fresh, crashes = state
        if is_update:
            return (True, 0), (None,)
        if not fresh:
            return state, (None,)
        if not is_crash:
            return (False, 0), ("stable",)
        if crashes + 1 >= limit:
            return (False, 0), ("rollback",)
        return (True, crashes + 1), ("crash",)

    return step


def update_stability(df: DataFrame, key: str, order: list[str], updated: str, crashed: str, limit: int = 3) -> DataFrame:
    """Adds verdict to boots: crash, rollback (the limit-th crash since the last update), stable (the first clean boot since), or null.

    updated marks rows that are the update itself; all others are boots.
    """
    return fold(df, key, order, [updated, crashed], lambda: (False, 0), stability_step(limit), "verdict string")


def connection_step(grace: int, failures: int) -> Callable:
    """The step of connection_state on (mode, down since, failures in a row, upload pending)."""

    def step(state, now, event):
        mode, since, run, pending = state
        offline = mode == "offline"
        if since is not None and now - since > grace:
            offline = True
        if event == "down":
            since = now if since is None else since
        elif event == "up":
            since = None
        elif event == "fail":
            run += 1
            if run >= failures:
                offline, run = True, 1
        elif event in ("ok", "reply"):
            since = None
            if offline:
                offline, run, pending = False, 0, True
            elif event == "ok":
                run = 0
        elif event == "uploaded":
            pending = False
        mode = "offline" if offline else "grace" if since is not None else "online"
        return (mode, since, run, pending), ("upload_pending" if mode == "online" and pending else mode,)

    return step


def connection_state(df: DataFrame, key: str, order: list[str], at: str, kind: str, grace: int, failures: int = 5) -> DataFrame:
    """Adds state after each event of a device: online, grace, offline or upload_pending.

    kind: `up` and `down` of the link, `ok` (200), `reply` (any other answer), `fail` (no answer),
    `uploaded`. The link being down for more than `grace` makes a device offline, and so does the
    failures-th failure in a row; any answer then ends that, with an upload pending until it is made.
    """
    return fold(df, key, order, [at, kind], lambda: ("online", None, 0, False), connection_step(grace, failures), "state string")


def spaced_retries(df: DataFrame, key: str, order: list[str], at: str, scheduled: Column, failed: Column, spacing: int, retries: int = 3) -> DataFrame:
    """retry_cycles for attempts that must lie apart: a failed attempt counts as a retry from `spacing` after the cycle's check or its last retry on; sooner, none is due."""

    def step(state, now, checks, fails):
        cycle, last, n = state
        if checks:
            return (cycle + 1, now, 0), (None, None, None)
        if not fails or not cycle or n >= retries or now - last < spacing:
            return state, (None, None, None)
        return (cycle, now, n + 1), (cycle, n + 1, n + 1 == retries)

    df = df.withColumns({"_scheduled": scheduled, "_failed": failed})
    out = fold(df, key, order, [at, "_scheduled", "_failed"], lambda: (0, None, 0), step, "cycle long, retry long, exhausted boolean")
    return out.filter("retry IS NOT NULL").drop("_scheduled", "_failed")


def due_uploads(df: DataFrame, key: str, order: list[str], at: str, queued: str, spacing: int) -> DataFrame:
    """Attempts that may be made: the live queue is empty, and the last such attempt is at least `spacing` ago; an unknown queue isn't empty."""

    def step(last, now, depth):
        due = depth == 0 and (last is None or now - last >= spacing)
        return (now if due else last), (due,)

    return fold(df, key, order, [at, queued], lambda: None, step, "due boolean").filter("due").drop("due")
