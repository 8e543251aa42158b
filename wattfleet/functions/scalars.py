"""Column expressions: calibration, rendering, codecs, clocks, versions, labels. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the devices.
GAIN, OFFSET, POWER_FACTOR = 0.0123, 0.13, 0.90
#: reason code -> (diagnostics label, heartbeat label)
BOOT_LABELS = {
    "poweron": ("Power-on", "power_on"),
    "sw": ("Software reset", "software"),
    "panic": ("Panic/crash", "panic"),
    "int_wdt": ("Interrupt watchdog", "int_watchdog"),
    "task_wdt": ("Task watchdog", "task_watchdog"),
    "wdt": ("Other watchdog", "watchdog"),
    "deepsleep": ("Deep sleep wake", "unknown"),
    "brownout": ("Brownout", "brownout"),
}
UNSYNCED = "1970-01-01T00:00:00.000Z"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def amps(avg_count: Column | str) -> Column:
    """Mean sample count to amps."""
    return F.lit(GAIN) * col(avg_count) + F.lit(OFFSET)


def finite_or_zero(c: Column | str) -> Column:
    """0 for NaN and infinities; null stays null."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def watts(volts: Column | str | float, current: Column | str, pf: float = POWER_FACTOR) -> Column:
    volts = F.lit(volts) if isinstance(volts, (int, float)) else col(volts)
    return volts * col(current) * F.lit(pf)


def trunc_int(c: Column | str) -> Column:
    """Towards zero."""
    return col(c).cast("int")


def fixed(c: Column | str, digits: int) -> Column:
    """As a number with so many decimals."""
    return F.round(col(c), digits)


def fixed_text(c: Column | str, digits: int) -> Column:
    """As text with exactly so many decimals."""
    return F.format_string(f"%.{digits}f", F.round(col(c), digits))


def to_milliamps(current: Column | str) -> Column:
    """Amps to signed 16-bit milliamps in single precision, truncated; over 32.767 A the value wraps to below zero."""
    low = (col(current).cast("float") * F.lit(1000.0).cast("float")).cast("int").bitwiseAND(F.lit(0xFFFF))
    return F.when(low >= 0x8000, low - 0x10000).otherwise(low)


def from_milliamps(ma: Column | str) -> Column:
    """Amps; readings are never below zero, so a negative value is one that wrapped."""
    return col(ma).cast("int").bitwiseAND(F.lit(0xFFFF)) / F.lit(1000.0)


def ma_wrapped(ma: Column | str) -> Column:
    return col(ma) < 0


def parse_ts(c: Column | str) -> Column:
    """UTC timestamp of text yyyy-MM-ddTHH:mm:ss.000Z; null for the unsynced clock's 1970 and for anything else."""
    return F.try_to_timestamp(F.nullif(col(c), F.lit(UNSYNCED)), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))


def format_ts(c: Column | str) -> Column:
    """Whole seconds; an unknown time becomes the 1970 sentinel."""
    return F.coalesce(F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss'.000Z'"), F.lit(UNSYNCED))


def semver(c: Column | str) -> Column:
    """struct(major, minor, patch); parts that are missing or no numbers are 0."""
    part = lambda n: F.coalesce(F.regexp_extract(col(c), r"^\s*(\d+)(?:\.(\d+))?(?:\.(\d+))?", n).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


def version_gt(a: Column | str, b: Column | str) -> Column:
    """Strictly greater."""
    return semver(a) > semver(b)


def force_http(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("https://"), F.lit("http://"))


def boot_label(code: Column | str, vocabulary: str = "diagnostics") -> Column:
    """The label of a reason code in the diagnostics or the heartbeat vocabulary."""
    k = {"diagnostics": 0, "heartbeat": 1}[vocabulary]
    out = F.when(F.lit(False), F.lit(""))
    for name, labels in BOOT_LABELS.items():
        out = out.when(col(code) == name, F.lit(labels[k]))
    return out.otherwise(F.concat(F.lit("Unknown ("), col(code), F.lit(")")) if k == 0 else F.lit("unknown"))


def is_crash(code: Column | str, rule: str = "crash") -> Column:
    """Three sets that differ: crash, post_update (all but clean boots and deep sleep), unexpected (all but clean boots)."""
    c = col(code)
    if rule == "crash":
        return c.isin("panic", "int_wdt", "task_wdt", "wdt", "brownout")
    return ~c.isin(*{"post_update": ("poweron", "sw", "deepsleep"), "unexpected": ("poweron", "sw")}[rule])


def truncate_utf8(c: Column | str, n: int) -> Column:
    """The first n bytes, without a character that the cut would split."""
    b = F.encode(col(c), "UTF-8")
    ends = [F.substring(b, 1, n - k) for k in range(4)]
    whole = F.when(F.length(b) <= n, col(c))
    for e in ends:
        whole = whole.when(F.is_valid_utf8(e.cast("string")), e.cast("string"))
    return whole


def truncate(c: Column | str, n: int) -> Column:
    """For ASCII; truncate_utf8 for the rest."""
    return F.substring(col(c), 1, n)


def offline_ts(epoch: Column | str, seq: Column | str, interval_s: int | Column = 1) -> Column:
    """The time of an offline row, which has none of its own."""
    return F.timestamp_seconds(col(epoch) + col(seq) * interval_s)


def offline_quality(epoch: Column | str) -> Column:
    return F.when(col(epoch) == 0, "unsynced").otherwise("estimated")


def elapsed_u32(now: Column | str, last: Column | str) -> Column:
    """Milliseconds between readings of a clock that wraps at 32 bits."""
    return F.pmod(col(now).cast("long") - col(last).cast("long"), F.lit(1 << 32))


def uptime_s(ms: Column | str) -> Column:
    return F.floor(col(ms) / 1000)


def kb(size: Column | str) -> Column:
    return F.floor(col(size) / 1024)


def ratio(raw: Column | str, compressed: Column | str) -> Column:
    return col(raw) / F.greatest(col(compressed), F.lit(1))


def failure_message(code: Column | str, text: Column | str) -> Column:
    return F.when(col(code) > 0, F.concat(F.lit("HTTP "), col(code).cast("string"))).otherwise(F.concat(F.lit("HTTP err: "), col(text)))


def backoff_ms(failures: Column | str) -> Column:
    """Milliseconds to wait after the k-th failure in a row: doubled from 1000 on, 5000 at most."""
    return F.least(F.lit(5000), F.lit(1000) * F.pow(F.lit(2), F.least(col(failures), F.lit(3))).cast("int"))
