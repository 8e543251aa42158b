"""Gates, validation and routing as columns; nothing is lost without a reason column or a second output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfleet.functions.scalars import UNSYNCED, col, version_gt

# Fixed values of the devices.
ACTIONS = ["set_interval", "set_voltage", "reboot", "debug_on", "debug_off", "update_firmware", "factory_reset"]
RATINGS = [50, 100, 150]
MAX_FIRMWARE, MAX_OFFLINE, HEADER = 1_310_720, 550_000, 40


def valid_payload(c: Column | str) -> Column:
    """Payloads of 200 to 767 bytes pass."""
    return F.octet_length(col(c)).between(200, 767)


def maybe_torn(c: Column | str) -> Column:
    """From 640 bytes on a queue slot is too short."""
    return F.octet_length(col(c)) >= 640


def non_stub(c: Column | str, least: int = 10, strict: bool = True) -> Column:
    n = F.octet_length(col(c))
    return n > least if strict else n >= least


def valid_cal_point(channel: Column | str, point: Column | str) -> Column:
    return col(channel).between(0, 5) & col(point).between(0, 2)


def validate_commands(df: DataFrame, action: str = "action", value: str = "value") -> DataFrame:
    """Adds accepted and reason. Values out of range are refused, not mended; a missing value counts as -1."""
    a, v = F.coalesce(F.col(action), F.lit("")), F.coalesce(F.col(value).cast("double"), F.lit(-1.0))
    reason = (
        F.when(a == "", "empty")
        .when(~a.isin(ACTIONS), "unknown")
        .when((a == "set_interval") & ((v != F.floor(v)) | ~v.between(1, 60)), "out of range")
        .when((a == "set_voltage") & ~v.between(100, 250), "out of range")
    )
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def update_eligibility(df: DataFrame, available: str = "update_available", version: str = "version", current: str = "current_version", url: str = "url", size: str = "size") -> DataFrame:
    """Adds eligible and reason: the first rule that fails."""
    reason = (
        F.when(~F.coalesce(F.col(available), F.lit(False)), "not available")
        .when(~version_gt(version, current), "not newer")
        .when(F.coalesce(F.col(url), F.lit("")) == "", "no url")
        .when(F.coalesce(F.col(size), F.lit(0)) <= 0, "no size")
        .when(F.col(size) > MAX_FIRMWARE, "too large")
    )
    return df.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())


def heap_class(free: Column | str) -> Column:
    return F.when(col(free) < 15_000, "critical").when(col(free) < 20_480, "low").otherwise("ok")


def route_outcome(code: Column | str, endpoint: str | Column = "live") -> Column:
    """What becomes of a delivery attempt, by HTTP code and endpoint (live or bulk)."""
    c, bulk = col(code), (F.lit(endpoint) if isinstance(endpoint, str) else endpoint) == "bulk"
    return (
        F.when(c == 200, F.when(bulk, "done").otherwise("sent"))
        .when(c == 400, F.when(bulk, "discarded").otherwise("rejected"))
        .when(c == 422, F.when(bulk, "discarded").otherwise("clock_dropped"))
        .otherwise("retry")
    )


def gate_offline_files(df: DataFrame, content: str = "content", length: str = "length") -> DataFrame:
    """Adds status (empty, bad_magic, ok) and capped to rows of the binaryFile source."""
    magic = F.substring(F.col(content), 1, 4) == F.lit("LS01").cast("binary")
    status = F.when(F.col(length) <= HEADER, "empty").when(~magic, "bad_magic").otherwise("ok")
    return df.withColumn("status", status).withColumn("capped", F.col(length) >= MAX_OFFLINE)


def is_unsynced(ts: Column | str = "timestamp") -> Column:
    """The sentinel of a clock that was never set, epoch 0, or no time."""
    text = col(ts).cast("string")
    return text.isNull() | text.isin(UNSYNCED, "0") | text.startswith("1970-01-01")


def mark_unsynced(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Adds side, good or bad; sources.stores.write_sides puts both away in one pass."""
    return df.withColumn("side", F.when(is_unsynced(ts), "bad").otherwise("good"))


def quarantine_unsynced(df: DataFrame, ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows have no usable time. Each is a pass of its own over df; mark_unsynced is for one pass."""
    bad = is_unsynced(ts)
    return df.filter(~bad), df.filter(bad)


def coerce_config(df: DataFrame, default_url: str = "http://localhost/data") -> DataFrame:
    """What saving a form does to volt, interval, rating and url: values out of range become defaults."""
    url = F.col("url")
    return df.withColumns(
        {
            "volt": F.when(F.col("volt").between(100, 250), F.col("volt")).otherwise(F.lit(230.0)),
            "interval": F.when(F.col("interval").between(1, 60), F.col("interval")).otherwise(F.lit(1)),
            "rating": F.when(F.col("rating").isin(RATINGS), F.col("rating")).otherwise(F.lit(50)),
            "url": F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.lit(default_url)),
        }
    )


def fill_config(df: DataFrame) -> DataFrame:
    """What loading does to missing values; a rating that was never saved is 30 here, not 50."""
    return df.withColumns({"rating": F.coalesce("rating", F.lit(30)), "tz": F.coalesce("tz", F.lit("UTC"))})


def dead_letter(df: DataFrame, key: str, order: str, text: str, cap: int = 50_000, start: DataFrame | None = None) -> DataFrame:
    """The rows that a log with a size cap takes: those before which it hadn't reached the cap; each takes its bytes and a line end of two.

    start: key and bytes of logs that hold something already, one row each.

    The running size needs a key's rows in order, but no more than cap / 2 + 1 of them, since each
    takes two bytes at least; Spark drops the others before the shuffle.
    """
    from pyspark.sql import Window

    first = Window.partitionBy(key).orderBy(order)
    before = F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 2).over(first.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= cap // 2 + 1).drop("_nth")
    df = df.withColumn("bytes_before", F.coalesce(before, F.lit(0)).cast("long"))
    if start is not None:
        start = start.select(F.col(key).alias("_key"), F.col("bytes").alias("_bytes"))
        df = df.join(start, df[key].eqNullSafe(F.col("_key")), "left").withColumn("bytes_before", F.col("bytes_before") + F.coalesce("_bytes", F.lit(0))).drop("_key", "_bytes")
    return df.filter(F.col("bytes_before") < cap)
