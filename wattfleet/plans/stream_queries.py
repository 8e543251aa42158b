"""Streams fed in several micro-batches, and stores that several jobs add to; their SQL is that of one pass over all rows.

A stream runs while slices of the table come one after the other.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from wattfleet.functions import quality, scalars
from wattfleet.plans.registry import SQL, events, micros, query, scratch, table
from wattfleet.plans.sequence_queries import _START, HOUR, KIND_SQL
from wattfleet.sources import stores
from wattfleet.streaming import event_time, streams
from wattfleet.streaming.late import LateRows, write_readings_batch, write_readings_stream

DAY = 24 * HOUR
#: Rows come up to two days out of order, so a watermark this far behind loses none.
DELAY = "3 days"


def out_of_order(rows: DataFrame, us: str = "us", ticks: int = 1) -> list[DataFrame]:
    """The rows in slices of eleven days in which a row can be up to two days late, then ticks, each a month after all before."""
    turn = F.floor((F.floor(F.col(us) / DAY) + F.col("event_id") % 3) / 11)
    sliced = rows.withColumn("_slice", turn)
    # a number for every eleven days
    found = sorted(r._slice for r in sliced.select("_slice").distinct().collect())
    end = rows.agg(F.max(us)).first()[0] or 0
    tick = lambda at: rows.sparkSession.range(1).select(*[(F.lit(at) if f.name == us else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    return [*(sliced.filter(F.col("_slice") == n).drop("_slice") for n in found), *(tick(end + 30 * DAY * (i + 1)) for i in range(ticks))]


def fed(spark: SparkSession, slices: list[DataFrame], start: Callable[[DataFrame, str], DataStreamWriter]) -> str:
    """Runs a stream over slices that come one after the other; start(stream, folder) says what becomes of them. The folder."""
    path, running = scratch(spark), None
    try:
        for s in slices:
            s.write.mode("append").parquet(f"{path}/in")
            if running is None:
                running = start(spark.readStream.schema(s.schema).parquet(f"{path}/in"), path).start()
            running.processAllAvailable()
    finally:
        if running is not None:
            running.stop()
    return path


def appended(spark: SparkSession, slices: list[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that build(stream) has given after all slices."""
    event_time.rocksdb(spark)
    schema = None

    def start(stream: DataFrame, path: str) -> DataStreamWriter:
        nonlocal schema
        out = build(stream)
        schema = out.schema
        return out.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")

    path = fed(spark, slices, start)
    return spark.read.schema(schema).parquet(f"{path}/rows")


def device_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", micros().alias("us"))


def as_time(c: str):
    return F.timestamp_micros(F.col(c)).cast("timestamp_ntz").alias(c)


IN_ORDER = ["us", "event_id"]


@query(SQL["throttle_1d"])
def throttle_stream(spark, sf_dir):
    e = device_rows(spark, sf_dir).select("event_id", "user_id", "us")
    return appended(spark, out_of_order(e), lambda s: event_time.throttle_stream(s, "user_id", IN_ORDER, "us", DAY, DELAY, keep_us=60 * DAY)).select("event_id", "kept")


@query(SQL["phase_slots_6h"])
def phase_slots_stream(spark, sf_dir):
    e = device_rows(spark, sf_dir).select("event_id", "user_id", "us")
    return appended(spark, out_of_order(e), lambda s: event_time.phase_slots_stream(s, "user_id", IN_ORDER, "us", 6 * HOUR, DELAY, _START)).select("event_id", "slot", "resynced")


@query(SQL["update_stability"])
def update_stability_stream(spark, sf_dir):
    t = F.col("event_type")
    e = device_rows(spark, sf_dir).select("event_id", "user_id", "us", (t == "signup").alias("updated"), (t == "error").alias("crashed"))
    return appended(spark, out_of_order(e), lambda s: event_time.stability_stream(s, "user_id", IN_ORDER, "updated", "crashed", DELAY)).select("event_id", "verdict")


@query(SQL["connection_state"])
def connection_state_stream(spark, sf_dir):
    e = device_rows(spark, sf_dir).select("event_id", "user_id", "us", F.expr(KIND_SQL).alias("kind"))
    return appended(spark, out_of_order(e), lambda s: event_time.connection_stream(s, "user_id", IN_ORDER, "us", "kind", 6 * HOUR, DELAY, failures=2)).select("event_id", "state")


@query(f"SELECT * FROM ({SQL['outages']}) WHERE outage_end IS NOT NULL")
def outages_stream(spark, sf_dir):
    """Outages that have ended."""
    e = device_rows(spark, sf_dir).select("event_id", "user_id", "us", (~F.col("event_type").isin("error", "purchase")).alias("connected"))
    out = appended(spark, out_of_order(e), lambda s: event_time.outages_stream(s, "user_id", IN_ORDER, "connected", DELAY, 21_600))
    return out.select("user_id", "rows", as_time("outage_start"), as_time("outage_end"), F.round("duration_s", 3).alias("duration_s"), "beyond_grace")


@query("SELECT user_id, ts AS silent_from FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events) WHERE next IS NULL OR next > ts + INTERVAL 24 HOUR")
def silent_now(spark, sf_dir):
    """Silences of more than a day, each told once, those of devices that never return as well."""
    e = device_rows(spark, sf_dir).select("event_id", "user_id", "us")
    return appended(spark, out_of_order(e), lambda s: event_time.silence_stream(s, "user_id", "us", DAY, DELAY)).select("user_id", as_time("silent_from"))


@query("""
    WITH b AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT * FROM events WHERE event_type = 'signup'),
    x AS (SELECT b.user_id, b.ts, c.ts AS config_at, c.value AS config_value FROM b ASOF LEFT JOIN c ON b.user_id = c.user_id AND b.ts >= c.ts)
    SELECT e.event_id, x.ts AS booted_at, x.config_at, x.config_value FROM (SELECT * FROM events WHERE event_type NOT IN ('signup', 'purchase')) e ASOF LEFT JOIN x ON e.user_id = x.user_id AND e.ts >= x.ts""")
def boot_effective_config_stream(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "config").when(F.col("event_type") == "purchase", "boot").otherwise("reading")
    e = device_rows(spark, sf_dir).withColumn("kind", kind).drop("event_type")
    out = appended(spark, out_of_order(e), lambda s: event_time.config_in_force_stream(s, "user_id", DELAY))
    return out.select("event_id", as_time("booted_at"), as_time("config_at"), "config_value")


@query("""
    WITH c AS (SELECT * FROM events WHERE event_type = 'click'), w AS (SELECT * FROM events WHERE event_type = 'purchase')
    SELECT c.event_id, min(w.ts) AS effect_at, arg_min(w.value, w.ts) AS effect_value FROM c LEFT JOIN w ON w.user_id = c.user_id AND w.ts BETWEEN c.ts AND c.ts + INTERVAL 86400 SECOND GROUP BY c.event_id""")
def command_effects_stream(spark, sf_dir):
    """Commands and writes as two streams; commands without an effect come out as well."""

    def build(rows):
        rows = rows.withColumn("at", F.timestamp_micros("us"))
        # a tick has no type and goes to both, so that both watermarks move
        side = lambda t: rows.filter((F.col("event_type") == t) | F.col("user_id").isNull())
        return event_time.command_effects_stream(side("click"), side("purchase"), "user_id", "event_id", 86_400, DELAY)

    # what the join gives at a tick, the aggregation gives at the next
    out = appended(spark, out_of_order(device_rows(spark, sf_dir), ticks=2), build).filter("event_id IS NOT NULL")
    return out.select("event_id", F.col("effect_at").cast("timestamp_ntz").alias("effect_at"), "effect_value")


@query("""
    WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
    s AS (SELECT *, count(*) FILTER (prev IS NULL OR ts >= prev + INTERVAL 6 HOUR) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM l)
    SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS reports FROM s GROUP BY user_id, session""")
def sessions_stream(spark, sf_dir):
    """Stretches of reports that have ended, by session windows in append mode."""

    def build(rows):
        at = rows.withColumn("at", F.timestamp_micros("us")).withWatermark("at", DELAY)
        return streams.silent_devices(at, "user_id", "at", "6 hours")

    out = appended(spark, out_of_order(device_rows(spark, sf_dir).select("event_id", "user_id", "us")), build).filter("user_id IS NOT NULL")
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")], "reports")


@query("""
    WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events WHERE event_id % 10 <> 9)
    SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (event_id % 10 = 9 AND ts < mark) AS came_late FROM events, m GROUP BY ALL""")
def late_rows_stream(spark, sf_dir):
    """Totals by device and day of a live stream, to which a tenth of the rows comes after all others: set apart, and their days stated anew."""
    e = device_rows(spark, sf_dir).select("event_id", "user_id", "value", "us")

    def build(rows):
        return rows.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))

    late, half = F.col("event_id") % 10 == 9, F.floor(F.col("us") / DAY) % 30 < 15
    store = None

    def start(stream, path):
        nonlocal store
        store = LateRows(f"{path}/store", "us", DAY, build)
        return store.writer(stream, f"{path}/state")

    # by half months, the earlier one first if the table starts with a month
    fed(spark, [e.filter(~late & half), e.filter(~late & ~half), e.filter(late)], start)
    store.finish(spark)
    late_n = store.late(spark).filter(late).groupBy("user_id", store.day().alias("day")).agg(F.count("*").alias("came_late"))
    out = store.daily(spark).join(late_n, ["user_id", "day"], "left")
    return out.select("user_id", F.date_add(F.lit("1970-01-01"), F.col("day").cast("int")).cast("string").alias("day"), "n", "total", F.coalesce("came_late", F.lit(0)).alias("came_late"))


@query("SELECT event_id, user_id, CAST(ts AS DATE)::VARCHAR AS date, value FROM events")
def readings_stream(spark, sf_dir):
    """The stream's sink, with a micro-batch that is written twice."""
    e = events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    slices = [e.filter(F.col("event_id") % 3 == i) for i in range(3)]
    path = fed(spark, slices, lambda stream, path: write_readings_stream(stream, f"{path}/readings", f"{path}/state"))
    write_readings_batch(slices[1], 1, f"{path}/readings")
    return spark.read.parquet(f"{path}/readings").select("event_id", "user_id", F.col("date").cast("string").alias("date"), "value")


@query(SQL["dead_letter_cap"])
def dead_letter_appends(spark, sf_dir):
    """Three appends to capped logs, one of them twice."""
    d, path = table(spark, sf_dir, "documents").select("doc_id", "source", "text"), scratch(spark)
    n = (d.agg(F.max("doc_id")).first()[0] or 0) + 1
    for batch in (0, 1, 1, 2):
        stores.write_dead_letters(d.filter(F.floor(F.col("doc_id") * 3 / n) == batch), path, "source", "doc_id", "text", batch)
    return stores.read_dead_letters(spark, path).select("doc_id", "source", "bytes_before")


@query(SQL["cal_points"])
def cal_points_upsert(spark, sf_dir):
    """Calibration points from three increments, the newest first, that cut recordings in two."""
    e, path = events(spark, sf_dir), scratch(spark)
    e = e.select(F.col("event_id"), (F.col("event_id") % 8 - 1).cast("int").alias("channel"), (F.col("event_id") % 4).cast("int").alias("point"), "value")
    for part in (2, 0, 1):
        stores.upsert_calibration(e.filter(F.floor(F.col("event_id") / 700) % 3 == part), path, "channel", "point", "value", "event_id")
    return stores.read_calibration(spark, path, ["channel", "point"]).withColumn("mean_value", F.round("mean_value", 6))


@query("SELECT event_id, user_id, value FROM events WHERE event_id % 2 = 1")
def snapshot_publish(spark, sf_dir):
    """A table published three times, of which the last try fails; readers have the second."""
    e, path = events(spark, sf_dir).select("event_id", "user_id", "value"), scratch(spark)
    stores.publish_snapshot(e, path)
    stores.publish_snapshot(e.filter("event_id % 2 = 1"), path)
    try:
        stores.publish_snapshot(e.withColumn("value", F.raise_error(F.lit("lost")).cast("double")), path)
    except Exception as failed:
        if "lost" not in str(failed):
            raise
    return stores.read_snapshot(spark, path)


@query(SQL["quarantine"])
def quarantine_store(spark, sf_dir):
    """Rows with and without a usable time put away in one pass over the source, each side in a folder of its own."""
    e, path = events(spark, sf_dir), scratch(spark)
    e = e.select("user_id", F.to_date("ts").cast("string").alias("ts_day"), "event_id", F.when(F.col("event_id") % 10 == 0, scalars.UNSYNCED).otherwise(F.col("ts").cast("string")).alias("timestamp"))
    stores.write_sides(quality.mark_unsynced(e), path, "side")
    return spark.read.parquet(path).select("user_id", "ts_day", "event_id", "side")
