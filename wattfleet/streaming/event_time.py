"""State machines on event time: rows wait until the watermark has passed them and are then worked on in order.

Rows of a device may come in any order within the delay, over any number of micro-batches. Spark
drops pieces that are behind the watermark, and of others the rows that their bucket has worked past
go (late.LateRows sets late rows apart first). Devices are dealt
out to BUCKETS by the hash of their key, and a bucket is what Spark groups by: what a device needs
is small, but every access to the state store is a call to the JVM, and every row that Spark hands to
a stateful process is converted by itself, so each by device and row cost more than all the work. So
tasks pack the rows of a bucket into pieces before the shuffle. Rows that wait are a list of pieces in
the state store, bounded by the delay; all else of a device is one small row. One timer per bucket fires when the next row of any of its devices is
due, when a silence has lasted, or when a state expires.

Time passes only with rows. A row with a null key is a tick: it moves the watermark and nothing
else, so that a stream without new rows can still finish what waits.

These streams need the RocksDB state store (`rocksdb`).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from wattfleet.operators.sequences import connection_step, phase_step, stability_step

#: Rows or devices in one entry of a list in the state store, and rows that a task holds while it packs them.
PIECE, HELD = 1000, 100_000
#: Groups that devices are dealt out to. A bucket's devices and waiting rows are in memory while it is worked on: some 500 devices of 540,000.
BUCKETS = 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> None:
    """Streams of this session that start from now on keep their state in RocksDB, and a micro-batch writes what it changed.

    Else every micro-batch copies the files of each store of each partition; a join of streams has four.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", True)


def millis(us: int) -> int:
    """The first millisecond that isn't before us."""
    return -(-us // 1000)


def add(state: ListState, items: list[tuple]) -> None:
    """Appends items, a piece in a call."""
    for i in range(0, len(items), PIECE):
        state.appendList([(pickle.dumps(items[i : i + PIECE]),)])


def unpacked(entries: Iterator[tuple[bytes]]) -> Iterator[tuple]:
    for (piece,) in entries:
        yield from pickle.loads(bytes(piece))


def same(key) -> Hashable:
    """Equal for keys that Spark groups together: lists and bytes have no hash in Python, and NaN isn't equal to itself."""
    return key if type(key).__hash__ is not None and key == key else repr(key)


class InOrder(StatefulProcessor):
    """Hands every device's rows to on_row() in order, each once the watermark has passed it.

    A subclass has a state of its own for a device, a tuple that starts as begin().
    """

    def __init__(self, names: list[str], key: str, order: list[str], keep_us: int | None):
        self.names, self.key, self.keep_us = names, names.index(key), keep_us
        self.at, self.order = names.index(order[0]), [names.index(c) for c in order]

    def begin(self) -> tuple:
        raise NotImplementedError

    def on_row(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        """The state after a row, and what comes out."""
        raise NotImplementedError

    def on_quiet(self, key, state: tuple, last: int, now: int) -> tuple[tuple, list[tuple], int | None]:
        """Called when all of a device's rows up to `now` are done: the state, what comes out, and when to be called again if nothing comes."""
        return state, [], None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "piece binary")
        # pieces of (key, when to look at it if nothing comes, its last row's time, *state)
        self.kept = handle.getListState("kept", "piece binary")
        # the timer, and the watermark up to which all rows are done
        self.mark = handle.getValueState("mark", "due long, passed long")
        self.out = Row(*self.columns)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:  # a tick
            for _ in rows:
                pass
            return
        due, passed = self.mark.get() or (None, None)
        new = due
        for _, first, piece, *_ in rows:
            if passed is not None and first <= passed:
                some = [row for row in pickle.loads(piece) if row[self.at] > passed]
                if not some:
                    continue
                first, piece = min(row[self.at] for row in some), pickle.dumps(some)
            self.waiting.appendValue((piece,))
            new = millis(first) if new is None else min(new, millis(first))
        if new != due:  # one timer at a time
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(new)
            self.mark.update((new, passed))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, fired = timerValues.getCurrentWatermarkInMs() * 1000, expiredTimerInfo.getExpiryTimeInMs()
        kept = {same(k): (k, look, last, state) for k, look, last, *state in unpacked(self.kept.get())}
        ready, later, next_row = {}, [], {}
        for row in unpacked(self.waiting.get()):
            device, us = same(row[self.key]), row[self.at]
            if us <= now:
                ready.setdefault(device, []).append(row)
            else:
                later.append(row)
                next_row[device] = min(us, next_row.get(device, us))
        for device in [*ready, *(d for d, (_, look, *_) in kept.items() if look is not None and look <= now and d not in ready)]:
            rows = ready.pop(device, [])
            name, _, last, state = kept.get(device) or (rows[0][self.key], None, None, self.begin())
            state = tuple(state)
            rows.sort(key=lambda row: [(row[c] is not None, row[c]) for c in self.order])
            for row in rows:
                state, found = self.on_row(state, row)
                last = row[self.at]
                for f in found:
                    yield self.out(*f)
            state, found, again = self.on_quiet(name, state, last, now)
            for f in found:
                yield self.out(*f)
            ends = None if self.keep_us is None else last + self.keep_us
            if ends is not None and ends <= now:
                if device not in next_row:
                    kept.pop(device, None)
                    continue
                ends = None  # a row waits, at which it is looked at again
            kept[device] = name, min((t for t in (again, ends) if t is not None), default=None), last, state
        for stored, items in ((self.waiting, later), (self.kept, [(k, look, last, *state) for k, look, last, state in kept.values()])):
            stored.clear()
            add(stored, items)
        dues = [*next_row.values(), *(look for _, look, *_ in kept.values() if look is not None)]
        due = max(millis(min(dues)), fired + 1) if dues else None  # the timer that fired is deleted after this
        if due is not None:
            self.handle.registerTimer(due)
        self.mark.update((due, now))

    def close(self) -> None:
        pass


class Fold(InOrder):
    """Rows with the values that step(state, *inputs) -> (state, values) gives."""

    def __init__(self, names, key, order, keep_us, inputs, start, step, added):
        super().__init__(names, key, order, keep_us)
        self.inputs, self.start, self.step, self.columns = [names.index(c) for c in inputs], start, step, [*names, *added]

    def begin(self):
        return self.start

    def on_row(self, state, row):
        state, values = self.step(state, *(row[i] for i in self.inputs))
        return tuple(state), [(*row, *values)]


class Silence(InOrder):
    """The last row before every silence of more than gap_us, as soon as it has lasted that long, whether or not a row follows."""

    def __init__(self, names, key, order, keep_us, gap_us):
        super().__init__(names, key, order, keep_us)
        self.gap_us, self.columns = gap_us, [key, "silent_from"]

    def begin(self):
        return False, None

    def on_row(self, state, row):
        told, before = state
        found = [(row[self.key], before)] if before is not None and not told and row[self.at] - before > self.gap_us else []
        return (False, row[self.at]), found

    def on_quiet(self, key, state, last, now):
        told, before = state
        if told or before is None:
            return state, [], None
        if now - before > self.gap_us:
            return (True, before), [(key, before)], None
        return state, [], before + self.gap_us + 1


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def packed(df: DataFrame, key: str, at: str, buckets: int) -> DataFrame:
    """Rows with a time as pieces of pickled rows of one bucket: _bucket (null for ticks), _first and _last of their times, _piece; a narrow map."""
    names = df.columns
    # the hash of equal keys is equal
    bucket = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(buckets)))

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        by: dict = {}
        for batch in held:
            *columns, numbers = [c.to_pylist() for c in batch.columns]
            for number, row in zip(numbers, zip(*columns)):
                by.setdefault(number, []).append(row)
        i, out = names.index(at), []
        for number, rows in by.items():
            for a in range(0, len(rows), PIECE):
                some = rows[a : a + PIECE]
                times = [row[i] for row in some]
                out.append((number, min(times), pickle.dumps(some), max(times)))
        columns = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["_bucket", "_first", "_piece", "_last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                yield pack(held)
                held = []
        if held:
            yield pack(held)

    return df.filter(F.col(at).isNotNull()).select(*names, bucket.alias("_bucket")).mapInArrow(run, "_bucket long, _first long, _piece binary, _last long")


def by_bucket(df: DataFrame, key: str, at: str, delay: str, process: InOrder, outputs: str, buckets: int) -> DataFrame:
    """Runs the process on a stream, whose columns it gets in their order."""
    pieces = packed(df, key, at, buckets).withColumn("_ts", F.timestamp_micros("_last")).withWatermark("_ts", delay)
    return pieces.groupBy("_bucket").transformWithState(process, outputs, "append", "eventTime")


def fold_in_order(df: DataFrame, key: str, order: list[str], inputs: list[str], start: tuple, step: Callable, outputs: str, delay: str, keep_us: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The streaming form of sequences.fold: the same rows with the same values, for rows out of order within the delay.

    order: the event time in microseconds first, then what decides ties. A key that has been silent
    for keep_us loses its state and starts anew; without it states stay. Rows without a time are
    left out.
    """
    added = [part.split()[0] for part in outputs.split(",")]
    process = Fold(df.columns, key, order, keep_us, inputs, start, step, added)
    return by_bucket(df, key, order[0], delay, process, f"{ddl(df)}, {outputs}", buckets)


def throttle_step(gap: int) -> Callable:
    """The step of sequences.throttle on (last kept,)."""

    def step(state, now):
        (last,) = state
        keep = last is None or now - last >= gap
        return (now if keep else last,), (keep,)

    return step


def throttle_stream(df: DataFrame, key: str, order: list[str], at: str, gap: int, delay: str, anchor: int | None = None, keep_us: int | None = None) -> DataFrame:
    """Adds kept, as sequences.throttle."""
    return fold_in_order(df, key, order, [at], (anchor,), throttle_step(gap), "kept boolean", delay, keep_us)


def phase_slots_stream(df: DataFrame, key: str, order: list[str], at: str, interval: int, delay: str, start: int = 0, keep_us: int | None = None) -> DataFrame:
    """Adds slot and resynced, as sequences.phase_slots."""
    return fold_in_order(df, key, order, [at], (start,), phase_step(interval), "slot long, resynced boolean", delay, keep_us)


def stability_stream(df: DataFrame, key: str, order: list[str], updated: str, crashed: str, delay: str, limit: int = 3, keep_us: int | None = None) -> DataFrame:
    """Adds verdict, as sequences.update_stability."""
    return fold_in_order(df, key, order, [updated, crashed], (False, 0), stability_step(limit), "verdict string", delay, keep_us)


def connection_stream(df: DataFrame, key: str, order: list[str], at: str, kind: str, grace: int, delay: str, failures: int = 5, keep_us: int | None = None) -> DataFrame:
    """Adds state, as sequences.connection_state."""
    return fold_in_order(df, key, order, [at, kind], ("online", None, 0, False), connection_step(grace, failures), "state string", delay, keep_us)


def outage_step(state: tuple, now: int, connected: bool) -> tuple[tuple, tuple]:
    """The step of outages on (start, rows): a connected row ends what has begun."""
    start, rows = state
    if connected:
        return (None, 0), (start, rows) if rows else (None, None)
    return (now if start is None else start, rows + 1), (None, None)


def outages_stream(df: DataFrame, key: str, order: list[str], flag: str, delay: str, grace_s: float = 30, keep_us: int | None = None) -> DataFrame:
    """Outages that have ended, as sequences.outages has them: key, outage_start, outage_end (in microseconds), rows, duration_s, beyond_grace."""
    out = fold_in_order(df, key, order, [order[0], flag], (None, 0), outage_step, "outage_start long, rows long", delay, keep_us).filter("outage_start IS NOT NULL")
    seconds = (F.col(order[0]) - F.col("outage_start")) / 1e6
    return out.select(key, "outage_start", F.col(order[0]).alias("outage_end"), "rows", seconds.alias("duration_s"), (seconds > grace_s).alias("beyond_grace"))


def silence_stream(df: DataFrame, key: str, at: str, gap_us: int, delay: str, keep_us: int | None = None) -> DataFrame:
    """key, silent_from (microseconds) of every silence of more than gap_us, once each, as soon as the watermark says that it has lasted so long; a device that never returns is reported as well.

    keep_us, if given, should be more than gap_us, or a state goes before its silence is told.
    """
    df = df.select(key, at)
    process = Silence(df.columns, key, [at], keep_us, gap_us)
    kind = df.schema[key].dataType.simpleString()
    return by_bucket(df, key, at, delay, process, f"`{key}` {kind}, silent_from long", BUCKETS)


def config_in_force_step(state: tuple, now: int, kind: str, value: float | None) -> tuple[tuple, tuple]:
    """The step of config_in_force on (last configuration's time and value; last boot's time, and what it read); no later row can ask for another."""
    config_at, config, *booted = state
    if kind == "config":
        config_at, config = now, value
    elif kind == "boot":
        booted = now, config_at, config
    return (config_at, config, *booted), tuple(booted)


def config_in_force_stream(events: DataFrame, key: str, delay: str) -> DataFrame:
    """event_id, booted_at, config_at (microseconds), config_value of every reading, as joins.enrich_as_of: the configuration written last at or before the last boot at or before it.

    events: one stream of key, us, event_id, kind (boot, config or reading) and value, so that one
    watermark stands for all of a device's rows.
    """
    # at one time configurations come before boots and those before readings; of two configurations the one with the largest id counts
    turn = F.when(F.col("kind") == "config", 0).when(F.col("kind") == "boot", 1).otherwise(2)
    rows = events.select(key, "us", "event_id", "kind", "value", turn.alias("turn"))
    outputs = f"booted_at long, config_at long, config_value {rows.schema['value'].dataType.simpleString()}"
    out = fold_in_order(rows, key, ["us", "turn", "event_id"], ["us", "kind", "value"], (None,) * 5, config_in_force_step, outputs, delay)
    return out.filter("turn = 2").select("event_id", "booted_at", "config_at", "config_value")


def command_effects_stream(commands: DataFrame, writes: DataFrame, key: str, command: str, within_s: int, delay: str) -> DataFrame:
    """Commands with the first write of the same device that follows within a time, and nulls where none does: command, effect_at, effect_value.

    commands: key, command, at; writes: key, at, value; at: a timestamp. An outer interval join of
    two streams, each with its watermark, so state is what lies between them and within_s; a
    command comes out once no write can follow in time. Ticks go to both streams.
    """
    # in a struct, for a filter on null keys would take ticks away before the watermark has seen them
    c = commands.select(F.struct(key).alias("_key"), command, F.col("at").alias("_asked")).withWatermark("_asked", delay)
    w = writes.select(F.struct(key).alias("_device"), F.col("at").alias("_written"), F.col("value").alias("_value")).withWatermark("_written", delay)
    follows = F.expr(f"_key = _device AND _written >= _asked AND _written <= _asked + INTERVAL {int(within_s)} SECONDS")
    found = c.join(w, follows, "left_outer").groupBy(command, "_asked").agg(F.min(F.struct("_written", "_value")).alias("_w"))
    return found.select(command, F.col("_w._written").alias("effect_at"), F.col("_w._value").alias("effect_value"))
