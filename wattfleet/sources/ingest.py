"""Ingest of JSON, key/value and console-log data into typed rows. Works on batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfleet.functions.quality import non_stub
from wattfleet.sources import schemas

PERMISSIVE = {"mode": "PERMISSIVE"}


def parse_readings(df: DataFrame, json_col: str, keep: list[str] | None = None) -> DataFrame:
    """One row per payload: the reading's fields, and malformed for text that is no reading."""
    r = F.from_json(F.col(json_col), schemas.READING, PERMISSIVE)
    out = df.withColumn("_r", r).select(*(keep or []), "_r.*")
    return out.withColumn("malformed", F.col("device_id").isNull() | F.col("readings").isNull())


def unpivot_channels(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per channel of a parsed reading: keep, channel, amps, real_power_w, pf, voltage_rms."""
    out = df.select(*keep, F.col("readings.voltage_rms").alias("voltage_rms"), F.explode("readings.cts").alias("_k", "_v"))
    return out.select(*keep, F.substring("_k", 4, 2).try_cast("int").alias("channel"), "_v.amps", "_v.real_power_w", "_v.pf", "voltage_rms")


def pivot_channels(df: DataFrame, keys: list[str], channel: str = "channel", fields: tuple[str, ...] = ("real_power_w", "amps", "pf"), n: int = 6) -> DataFrame:
    """The inverse: channels as a map ct_1 ... ct_n."""
    at = F.concat(F.lit("ct_"), F.col(channel).cast("string"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(channel), at.alias("k"), F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias("v"))))
    return df.filter(F.col(channel).between(1, n)).groupBy(*keys).agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"], e["v"]))).alias("cts"))


def to_payload(device_id: Column, timestamp: Column, location: Column, timezone: Column, cts: Column, voltage: Column) -> Column:
    """A reading as JSON, with the decimals that devices send."""
    round_ct = F.transform_values(cts, lambda k, v: F.struct(F.round(v["real_power_w"], 1).alias("real_power_w"), F.round(v["amps"], 3).alias("amps"), F.round(v["pf"], 3).alias("pf")))
    return F.to_json(F.struct(device_id.alias("device_id"), timestamp.alias("timestamp"), location.alias("location"), timezone.alias("timezone"), F.struct(round_ct.alias("cts"), F.round(voltage, 1).alias("voltage_rms")).alias("readings")))


def parse_heartbeats(df: DataFrame, json_col: str, keep: list[str] | None = None, explode: bool = False) -> DataFrame:
    """Heartbeats with their errors as an array, or one row per error (a null one if there is none)."""
    out = df.withColumn("_h", F.from_json(F.col(json_col), schemas.HEARTBEAT, PERMISSIVE)).select(*(keep or []), "_h.*")
    if explode:
        out = out.withColumn("_e", F.explode_outer("errors")).drop("errors").select("*", F.col("_e.timestamp").alias("error_timestamp"), F.col("_e.message").alias("error_message")).drop("_e")
    return out


def parse_diagnostics(df: DataFrame, json_col: str, keep: list[str] | None = None) -> DataFrame:
    return df.withColumn("_d", F.from_json(F.col(json_col), schemas.DIAGNOSTICS, PERMISSIVE)).select(*(keep or []), "_d.*")


def parse_commands(df: DataFrame, json_col: str, keep: list[str], limit: int = 10) -> DataFrame:
    """The first `limit` commands of each batch in order; empty ones count."""
    c = F.slice(F.from_json(F.col(json_col), schemas.COMMANDS, PERMISSIVE)["commands"], 1, limit)
    return df.select(*keep, F.posexplode(c).alias("position", "_c")).select(*keep, "position", "_c.action", "_c.value")


def parse_firmware_offers(df: DataFrame, url_col: str, json_col: str, keep: list[str] | None = None) -> DataFrame:
    """Checks with what they asked (device_id, current_version) and were offered; defaults: no update, "unknown", ""."""
    o = F.from_json(F.col(json_col), schemas.OFFER, PERMISSIVE)
    query = lambda k: F.try_parse_url(F.col(url_col), F.lit("QUERY"), F.lit(k))
    return df.select(
        *(keep or []),
        query("device_id").alias("device_id"),
        query("version").alias("current_version"),
        F.coalesce(o["update_available"], F.lit(False)).alias("update_available"),
        F.coalesce(o["version"], F.lit("unknown")).alias("version"),
        F.coalesce(o["url"], F.lit("")).alias("url"),
    )


def read_buffer_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Readings of saved queues (a JSON array per file); files that don't parse and stubs are left out."""
    rows = spark.read.schema(f"{schemas.READING}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path)
    rows = rows.withColumn("_file", F.col("_metadata.file_path"))
    return rows.filter("_corrupt IS NULL").filter(non_stub(F.to_json(F.struct("device_id", "timestamp", "readings")))).drop("_corrupt")


def parse_buffer_snapshots(df: DataFrame, json_col: str, keep: list[str] | None = None) -> DataFrame:
    """Readings of saved queues that are values of a column, as where many devices' queues lie in one file; queues that don't parse and stubs are left out."""
    queue = F.from_json(F.col(json_col), f"array<struct<{', '.join(part.strip().replace(' ', ': ', 1) for part in fields(schemas.READING))}>>", PERMISSIVE)
    rows = df.select(*(keep or []), F.explode(queue).alias("_q")).select(*(keep or []), "_q.*")
    return rows.filter(non_stub(F.to_json(F.struct("device_id", "timestamp", "readings"))))


def fields(ddl: str) -> list[str]:
    """The fields of a DDL list, with what is nested in them."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def read_error_logs(spark: SparkSession, path: str, most: int = 30) -> DataFrame:
    """Saved error logs, one per file: file, position, timestamp, message; see parse_error_logs."""
    return parse_error_logs(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"), "value", ["file"], most)


def parse_error_logs(df: DataFrame, json_col: str, keep: list[str] | None = None, most: int = 30) -> DataFrame:
    """Entries of error logs that are values of a column: keep, position, timestamp, message; missing fields are "", of a log the first `most` entries count."""
    logs = df.select(*(keep or []), F.from_json(F.col(json_col), schemas.ERRORS, PERMISSIVE).alias("_e"))
    out = logs.select(*(keep or []), F.posexplode(F.slice("_e", 1, most)).alias("position", "_e"))
    return out.select(*(keep or []), "position", F.coalesce("_e.t", F.lit("")).alias("timestamp"), F.coalesce("_e.m", F.lit("")).alias("message"))


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """Logs of rejected readings, one JSON per line."""
    return parse_readings(spark.read.text(path).filter("value != ''"), "value", ["value"])


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


CONFIG_KEYS = ["devid", "loc", "url", "volt", "ct1", "ct2", "ct3", "ct4", "ct5", "ct6", "interval", "tz"]


def config_from_kv(kv: DataFrame, device: str = "device_id", at: list[str] | None = None) -> DataFrame:
    """One typed row per device from its key/value writes, the last of each key; passwords and unknown keys never enter."""
    order = F.struct(*(at or ["written_at"]))
    last = kv.filter(F.col("key").isin(CONFIG_KEYS)).groupBy(device).agg(*[F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, order)).alias(k) for k in CONFIG_KEYS])
    numbers = {"volt": "double", "interval": "int", **{f"ct{i}": "int" for i in range(1, 7)}}
    return last.withColumns({k: F.col(k).try_cast(t) for k, t in numbers.items()})


def calibration_from_kv(kv: DataFrame, device: str = "device_id") -> DataFrame:
    """Calibration points (channel, point, mv, amps; 0 if missing) of devices whose mcal flag is set."""
    last = kv.groupBy(device, "key").agg(F.max_by("value", "written_at").alias("value"))
    set_up = last.filter("key = 'mcal' AND lower(value) IN ('1', 'true')").select(device)
    part = lambda n: F.regexp_extract("key", r"^c([0-5])p([0-2])(mv|a)$", n)
    points = last.filter(part(3) != "").select(device, part(1).cast("int").alias("channel"), part(2).cast("int").alias("point"), part(3).alias("what"), F.col("value").try_cast("double").alias("x"))
    value = lambda k: F.coalesce(F.max(F.when(F.col("what") == k, F.col("x"))), F.lit(0.0))
    return points.join(set_up, device, "left_semi").groupBy(device, "channel", "point").agg(value("mv").alias("mv"), value("a").alias("amps"))


def parse_console(df: DataFrame, line: str, keep: list[str] | None = None) -> DataFrame:
    """Console lines of four shapes, by kind: online, offline, diag, block; other lines are `other`."""
    c = F.col(line)
    kind = F.when(c.rlike(r"^\[OFFLINE\] Blk\d+:"), "block").when(c.startswith("[OFFLINE] "), "offline").when(c.startswith("[DIAG] Up:"), "diag").when(c.rlike(r"^\[\d{4}-\d\d-\d\dT"), "online").otherwise("other")
    get = lambda p, t: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast(t)
    return df.select(
        *(keep or []),
        kind.alias("kind"),
        get(r"^\[(\d{4}[^\]]*)\]", "string").alias("timestamp"),
        get(r"\] ([-\d.]+)W \|", "double").alias("total_watts"),
        get(r"\| Q:(\d+) ", "int").alias("queue"),
        F.coalesce(get(r" S:(\d+)", "long"), get(r"Stored:(\d+)", "long")).alias("stored_or_sent"),
        F.coalesce(get(r"File:(\d+)KB", "long"), get(r", (\d+)KB total", "long")).alias("file_kb"),
        get(r"\| (\d+)ms", "long").alias("sample_ms"),
        get(r"Up:(\d+)s", "long").alias("uptime_s"),
        get(r"Heap:(\d+)\(", "long").alias("free_heap"),
        get(r"\(min:(\d+)\)", "long").alias("min_heap"),
        get(r" F:(\d+)", "long").alias("failed"),
        get(r" D:(\d+)", "long").alias("dropped"),
        get(r"RSSI:(-?\d+)", "int").alias("rssi"),
        get(r"Blk\d+: (\d+) rdgs", "int").alias("block_readings"),
        get(r"rdgs, (\d+)->", "long").alias("raw_bytes"),
        get(r"->(\d+) bytes", "long").alias("data_bytes"),
    )


