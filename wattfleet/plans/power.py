"""Calibration, aggregation and status queries."""

from pyspark.sql import functions as F

from wattfleet.functions import quality, scalars
from wattfleet.operators import aggregates, sequences
from wattfleet.plans.registry import CODE_SQL, ORDER, REASON_SQL, channel, code, events, micros, query, reason, table
from wattfleet.streaming import streams


@query("""
    WITH c AS (SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, 0.0123 * avg(value) + 0.13 AS amps FROM events GROUP BY user_id, CAST(ts AS DATE), event_id % 6 + 1)
    SELECT user_id, day, round(sum(amps), 9) AS total_amps, round(sum(230.0 * amps * 0.90), 8) AS total_watts FROM c GROUP BY user_id, day""")
def calibrated_power(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"channel": channel(), "day": F.to_date("ts").cast("string")})
    means = e.groupBy("user_id", "day", "channel").agg(F.avg("value").alias("avg_count"))
    out = aggregates.calibrated(means).groupBy("user_id", "day").agg(F.sum("amps").alias("a"), F.sum("watts").alias("w"))
    return out.select("user_id", "day", F.round("a", 9).alias("total_amps"), F.round("w", 8).alias("total_watts"))


@query("""
    SELECT l_orderkey, CAST(l_linenumber % 6 AS BIGINT) AS channel, round(sum(l_quantity) / 500, 6) AS avg_count, CAST(trunc(sum(l_quantity) / 500 * 1000) AS BIGINT) AS avg_mv, count(*) AS n_samples
    FROM lineitem GROUP BY ALL""")
def sample_means(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 6).cast("long").alias("channel"), F.col("l_quantity").cast("double"))
    out = aggregates.window_means(li, ["l_orderkey"], count="l_quantity")
    return out.select("l_orderkey", "channel", F.round("avg_count", 6).alias("avg_count"), scalars.trunc_int(F.col("avg_count") * 1000).cast("long").alias("avg_mv"), "n_samples")


@query("SELECT user_id, round(sum(0.0123 * value + 0.13) * 230.0 * 0.9, 8) AS total_watts FROM events GROUP BY user_id")
def total_watts(spark, sf_dir):
    c = aggregates.calibrated(events(spark, sf_dir), "value")
    return aggregates.total_watts(c, ["user_id"]).select("user_id", F.round("total_watts", 8).alias("total_watts"))


@query(f"""
    SELECT user_id, count(*) FILTER (code = 200) AS sent, count(*) FILTER (code = 400) AS rejected, count(*) FILTER (code = 422) AS clock_dropped,
           count(*) FILTER (code = 500) AS failed, count(*) AS attempts FROM (SELECT *, {CODE_SQL} AS code FROM events) GROUP BY user_id""")
def delivery_counters(spark, sf_dir):
    return aggregates.delivery_counters(events(spark, sf_dir).withColumn("http_code", code()), ["user_id"])


@query("""
    WITH g AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM events)
    SELECT event_id, user_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, since ORDER BY ts, event_id) AS crash_count FROM g""")
def crash_count(spark, sf_dir):
    out = aggregates.crash_count(events(spark, sf_dir), "user_id", ORDER, F.col("event_type") == "error", F.col("event_type") == "purchase")
    return out.select("event_id", "user_id", "crash_count")


@query("""
    WITH b AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS boot FROM events)
    SELECT event_id, boot, min(value) OVER (PARTITION BY user_id, boot ORDER BY ts, event_id) AS min_heap FROM b""")
def heap_low_water(spark, sf_dir):
    from pyspark.sql import Window

    boot = F.count_if(F.col("event_type") == "purchase").over(Window.partitionBy("user_id").orderBy(*ORDER))
    return aggregates.heap_low_water(events(spark, sf_dir).withColumn("boot", boot), ["user_id", "boot"], ORDER, "value").select("event_id", "boot", "min_heap")


@query("""
    WITH c AS (SELECT *, event_id % 97 AS uptime, CAST(floor(value) AS BIGINT) AS counter FROM events),
    l AS (SELECT *, lag(counter) OVER w AS c0, lag(uptime) OVER w AS u0 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, CASE WHEN u0 IS NULL OR uptime < u0 THEN counter ELSE counter - c0 END AS increase FROM l""")
def counter_increase(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"uptime": F.col("event_id") % 97, "counter": F.floor("value")})
    return aggregates.counter_increase(e, "user_id", ORDER, "counter", "uptime").select("event_id", "user_id", "increase")


@query("""
    SELECT date_trunc('day', ts) AS window_start, user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS reports
    FROM events GROUP BY ALL""")
def health_report_1d(spark, sf_dir):
    return aggregates.health_report(events(spark, sf_dir), "user_id", "ts", "1 day", ["value", "event_type"], "event_id")


@query("""
    WITH g AS (SELECT event_id % 8 - 1 AS channel, event_id % 4 AS point, event_id // 500 AS run, value, event_id FROM events),
    r AS (SELECT channel, point, run, avg(value) AS m, max(event_id) AS last_id, count(*) AS n FROM g WHERE channel BETWEEN 0 AND 5 AND point BETWEEN 0 AND 2 GROUP BY ALL)
    SELECT channel, point, round(arg_max(m, last_id), 6) AS mean_value, max(last_id) AS recorded_at, arg_max(n, last_id) AS n_samples FROM r GROUP BY ALL""")
def cal_points(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"channel": F.col("event_id") % 8 - 1, "point": F.col("event_id") % 4})
    return aggregates.calibration_points(e, "channel", "point", "value", "event_id").withColumn("mean_value", F.round("mean_value", 6))


@query("""
    SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, event_id % 6 + 1 AS channel, round(sum(value) / 500, 6) AS avg_count, count(*) AS n_samples,
           max(max(epoch_us(ts))) OVER (PARTITION BY user_id, CAST(ts AS DATE)) - min(min(epoch_us(ts))) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS duration_us
    FROM events GROUP BY user_id, CAST(ts AS DATE), event_id % 6 + 1""")
def timed_windows(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.to_date("ts").cast("string").alias("day"), (F.col("event_id") % 6 + 1).alias("channel"), "value", micros().alias("us"))
    out = aggregates.timed_window_means(e, ["user_id", "day"], "us", count="value")
    return out.withColumn("avg_count", F.round("avg_count", 6)).withColumnRenamed("duration", "duration_us")


@query("""
    WITH p AS (SELECT user_id, max(ts) AS last_reading, """ + ", ".join(f"arg_max(0.0123 * value + 0.13, (ts, event_id)) FILTER (event_id % 6 + 1 = {c}) AS a{c}" for c in range(1, 7)) + """ FROM events WHERE event_type <> 'signup' GROUP BY user_id),
    h AS (SELECT user_id, max(ts) AS last_heartbeat, arg_max(event_id, (ts, event_id)) AS beat FROM events WHERE event_type = 'signup' GROUP BY user_id)
    SELECT user_id, last_reading, last_heartbeat, -(beat % 90) AS wifi_rssi, beat % 30 AS queue_depth, beat AS total_sent, beat % 7 AS total_failed, beat % 3 AS total_dropped,
           """ + ", ".join(f"round(a{c}, 6) AS ct_{c}_amps, round(a{c} * 230.0 * 0.9, 6) AS ct_{c}_watts" for c in range(1, 7)) + """,
           CASE WHEN last_reading IS NOT NULL THEN round(""" + " + ".join(f"coalesce(a{c} * 230.0 * 0.9, 0)" for c in range(1, 7)) + """, 6) END AS total_watts
    FROM p FULL JOIN h USING (user_id)""")
def device_report(spark, sf_dir):
    e = events(spark, sf_dir)
    readings = aggregates.calibrated(e.filter("event_type != 'signup'").withColumn("channel", channel()), "value")
    i = F.col("event_id")
    beats = e.filter("event_type = 'signup'").select("user_id", *ORDER, (-(i % 90)).alias("wifi_rssi"), (i % 30).alias("queue_depth"), i.alias("total_sent"), (i % 7).alias("total_failed"), (i % 3).alias("total_dropped"))
    out = aggregates.device_report(readings, beats, "user_id", ORDER, ["wifi_rssi", "queue_depth", "total_sent", "total_failed", "total_dropped"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith(("_amps", "_watts"))})


@query("SELECT user_id, max(ts) AS last_seen, count(*) AS readings, round(sum(value), 4) AS total, " + ", ".join(f"arg_max(value, (ts, event_id)) FILTER (event_id % 6 + 1 = {c}) AS ct_{c}" for c in range(1, 7)) + " FROM events GROUP BY user_id")
def device_status(spark, sf_dir):
    out = aggregates.device_status(events(spark, sf_dir).withColumn("channel", channel()), "user_id", ORDER)
    return out.withColumn("total", F.round("total", 4))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_by_user(spark, sf_dir):
    return streams.latest_by_key(events(spark, sf_dir).drop("props"), "user_id", ORDER)


@query("""
    SELECT event_id, round(value, 1) AS watts_1, round(value, 3) AS amps_3, printf('%.1f', round(value, 1)) AS watts_text, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') AS stamp, date_trunc('second', ts) AS parsed,
           (event_id * 1000 - 4294967000 + 4294967296 * 10) % 4294967296 AS elapsed, (event_id * 1000) // 1000 AS uptime, event_id // 1024 AS size_kb, value / greatest(event_id % 7, 1) AS compression,
           CASE WHEN event_id % 3 > 0 THEN 'HTTP ' || (event_id % 3) ELSE 'HTTP err: ' || event_type END AS message,
           0.0123 * value + 0.13 AS amps, CAST(trunc(value) AS INTEGER) AS avg_int
    FROM events""")
def render_scalars(spark, sf_dir):
    e, id_ = events(spark, sf_dir), F.col("event_id")
    stamp = scalars.format_ts("ts")
    return e.select(
        "event_id",
        scalars.fixed("value", 1).alias("watts_1"),
        scalars.fixed("value", 3).alias("amps_3"),
        scalars.fixed_text("value", 1).alias("watts_text"),
        stamp.alias("stamp"),
        F.convert_timezone(F.lit("UTC"), F.lit("UTC"), scalars.parse_ts(stamp).cast("timestamp_ntz")).alias("parsed"),
        scalars.elapsed_u32(id_ * 1000, F.lit(4_294_967_000)).alias("elapsed"),
        scalars.uptime_s(id_ * 1000).alias("uptime"),
        scalars.kb("event_id").alias("size_kb"),
        scalars.ratio("value", id_ % 7).alias("compression"),
        scalars.failure_message(id_ % 3, "event_type").alias("message"),
        scalars.finite_or_zero(scalars.amps("value")).alias("amps"),
        scalars.trunc_int("value").alias("avg_int"),
    )


@query("SELECT page_id, replace(url, 'https://', 'http://') AS plain_url, substr(url, 1, 31) AS short_url FROM pages")
def text_scalars(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.force_http("url").alias("plain_url"), scalars.truncate("url", 31).alias("short_url"))


@query(f"""
    SELECT event_id, CASE r WHEN 'sw' THEN 'Software reset' WHEN 'deepsleep' THEN 'Deep sleep wake' WHEN 'panic' THEN 'Panic/crash' WHEN 'poweron' THEN 'Power-on' ELSE 'Brownout' END AS diagnostics_label,
           CASE r WHEN 'sw' THEN 'software' WHEN 'deepsleep' THEN 'unknown' WHEN 'panic' THEN 'panic' WHEN 'poweron' THEN 'power_on' ELSE 'brownout' END AS heartbeat_label,
           r IN ('panic', 'brownout') AS crash, r IN ('panic', 'brownout') AS post_update_crash, r IN ('panic', 'brownout', 'deepsleep') AS unexpected
    FROM (SELECT event_id, {REASON_SQL} AS r FROM events)""")
def boot_labels(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("r", reason())
    return e.select("event_id", scalars.boot_label("r").alias("diagnostics_label"), scalars.boot_label("r", "heartbeat").alias("heartbeat_label"), scalars.is_crash("r").alias("crash"), scalars.is_crash("r", "post_update").alias("post_update_crash"), scalars.is_crash("r", "unexpected").alias("unexpected"))


@query("""
    SELECT doc_id, octet_length(encode(text)) BETWEEN 200 AND 767 AS valid, octet_length(encode(text)) >= 640 AS torn, octet_length(encode(text)) > 10 AS saved, octet_length(encode(text)) >= 10 AS sendable FROM documents""")
def length_gates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", quality.valid_payload("text").alias("valid"), quality.maybe_torn("text").alias("torn"), quality.non_stub("text").alias("saved"), quality.non_stub("text", 10, False).alias("sendable"))


_COMMAND = "CASE event_type WHEN 'click' THEN 'set_interval' WHEN 'view' THEN 'set_voltage' WHEN 'signup' THEN 'reboot' WHEN 'purchase' THEN 'open_door' ELSE '' END"


@query(f"""
    SELECT event_id, action, reason, reason IS NULL AS accepted FROM (SELECT event_id, action, CASE WHEN action = '' THEN 'empty' WHEN action = 'open_door' THEN 'unknown'
        WHEN action = 'set_interval' AND NOT (v BETWEEN 1 AND 60) THEN 'out of range' WHEN action = 'set_voltage' AND NOT (v BETWEEN 100 AND 250) THEN 'out of range' END AS reason
        FROM (SELECT event_id, {_COMMAND} AS action, floor(value) AS v FROM events))""")
def command_validation(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.expr(_COMMAND).alias("action"), F.floor("value").cast("double").alias("value"))
    return quality.validate_commands(e).select("event_id", "action", "reason", "accepted")


@query("SELECT event_id, CASE WHEN value * 100 < 15000 THEN 'critical' WHEN value * 100 < 20480 THEN 'low' ELSE 'ok' END AS heap FROM events")
def heap_class(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", quality.heap_class(F.col("value") * 100).alias("heap"))


@query(f"""
    SELECT event_id, CASE code WHEN 200 THEN 'sent' WHEN 400 THEN 'rejected' WHEN 422 THEN 'clock_dropped' ELSE 'retry' END AS live,
           CASE code WHEN 200 THEN 'done' WHEN 400 THEN 'discarded' WHEN 422 THEN 'discarded' ELSE 'retry' END AS bulk FROM (SELECT event_id, {CODE_SQL} AS code FROM events)""")
def route_outcome(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", quality.route_outcome(code()).alias("live"), quality.route_outcome(code(), "bulk").alias("bulk"))


@query("""
    WITH r AS (SELECT source, doc_id, coalesce(sum(octet_length(encode(coalesce(text, ''))) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bytes_before FROM documents)
    SELECT * FROM r WHERE bytes_before < 50000""")
def dead_letter_cap(spark, sf_dir):
    return quality.dead_letter(table(spark, sf_dir, "documents"), "source", "doc_id", "text").select("source", "doc_id", "bytes_before")


@query("""
    SELECT user_id, ts_day, event_id, CASE WHEN event_id % 10 = 0 THEN 'bad' ELSE 'good' END AS side FROM (SELECT user_id, CAST(ts AS DATE)::VARCHAR AS ts_day, event_id FROM events)""")
def quarantine(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("timestamp", F.when(F.col("event_id") % 10 == 0, scalars.UNSYNCED).otherwise(scalars.format_ts("ts")))
    good, bad = quality.quarantine_unsynced(e)
    out = good.withColumn("side", F.lit("good")).unionByName(bad.withColumn("side", F.lit("bad")))
    return out.select("user_id", F.to_date("ts").cast("string").alias("ts_day"), "event_id", "side")


@query("""
    SELECT user_id, block, count(*) AS n_rows, min(event_id) AS lo, max(event_id) AS hi FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS block FROM events) GROUP BY ALL""")
def block_pack(spark, sf_dir):
    out = sequences.pack_blocks(events(spark, sf_dir), "user_id", ORDER, ["event_id", "value"])
    ids = F.transform("rows", lambda r: r["event_id"])
    return out.select("user_id", "block", F.col("n_rows").cast("long").alias("n_rows"), F.array_min(ids).alias("lo"), F.array_max(ids).alias("hi"))


@query("""
    WITH b AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS block, octet_length(encode(props)) AS n FROM events),
    k AS (SELECT user_id, block, count(*) AS readings, count(*) * 12 AS raw, sum(n) AS size FROM b GROUP BY ALL)
    SELECT user_id, sum(readings)::BIGINT AS readings, count(*) AS blocks, sum(size + 2)::BIGINT + 40 AS file_bytes, round(sum(raw) / greatest(sum(size), 1), 6) AS ratio FROM k GROUP BY user_id""")
def offline_rollup(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("n", F.octet_length("props"))
    blocks = sequences.pack_blocks(e, "user_id", ORDER, ["n"]).select(F.col("user_id").alias("path"), F.col("n_rows").cast("long").alias("readings"), (F.col("n_rows") * 12).cast("long").alias("raw_bytes"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["n"]).alias("data_bytes"))
    return aggregates.offline_rollup(blocks).select(F.col("path").alias("user_id"), "readings", "blocks", "file_bytes", F.round("ratio", 6).alias("ratio"))
