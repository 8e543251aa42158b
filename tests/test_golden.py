"""Golden vectors and quirks of single expressions."""

import pytest
from pyspark.sql import functions as F

from wattfleet.functions import quality, scalars


def column(spark, values, kind, f):
    rows = list(enumerate(values))
    return [r.y for r in spark.createDataFrame(rows, f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_calibration(spark):
    counts = [0.0, 1.0, 100.0, 1234.5, 2048.0, 4095.0]
    amps = column(spark, counts, "double", scalars.amps)
    assert amps == pytest.approx([0.130, 0.1423, 1.360, 15.31435, 25.3204, 50.4985], abs=1e-9)
    watts = column(spark, counts, "double", lambda c: scalars.fixed(scalars.watts(230.0, scalars.amps(c)), 1))
    assert watts[:5] == pytest.approx([26.9, 29.5, 281.5, 3170.1, 5241.3])
    assert 6 * 230 * 0.13 * 0.9 == pytest.approx(161.46)


def test_finite(spark):
    assert column(spark, [1.5, float("nan"), float("inf"), float("-inf"), None], "double", scalars.finite_or_zero) == [1.5, 0.0, 0.0, 0.0, None]


def test_milliamps(spark):
    amps = lambda c: scalars.to_milliamps((c * F.lit(0.0123).cast("float") + F.lit(0.13).cast("float")).cast("float"))
    got = column(spark, [0.0, 1.0, 100.0, 2048.0, 4095.0], "float", amps)
    assert got == [130, 142, 1360, 25320, -15038]
    assert column(spark, got, "int", scalars.from_milliamps) == [0.13, 0.142, 1.36, 25.32, 50.498]
    assert column(spark, got, "int", scalars.ma_wrapped) == [False] * 4 + [True]


def test_backoff(spark):
    assert column(spark, [0, 1, 2, 3, 4, 5, 6, 60], "int", scalars.backoff_ms) == [1000, 2000, 4000, 5000, 5000, 5000, 5000, 5000]


def test_versions(spark):
    rows = [("2.10.0", "2.9.5", True), ("2.6", "2.6.0", False), ("unknown", "0.0.0", False), ("2.6.1", "2.6", True), ("1.0", "2.0", False), ("", "0", False), (None, "1", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.filter(scalars.version_gt("a", "b") != F.col("want")).count() == 0


def test_timestamps(spark):
    texts = ["2024-01-31T23:59:59.000Z", scalars.UNSYNCED, "junk", None]
    out = column(spark, texts, "string", lambda c: scalars.format_ts(scalars.parse_ts(c)))
    assert out == [texts[0], scalars.UNSYNCED, scalars.UNSYNCED, scalars.UNSYNCED]


def test_clock_wraps(spark):
    df = spark.createDataFrame([(5, 4_294_967_290, 11), (100, 40, 60)], "now long, last long, want long")
    assert df.filter(scalars.elapsed_u32("now", "last") != F.col("want")).count() == 0


def test_bounded_strings(spark):
    assert column(spark, ["é" * 40, "a" * 40, "short", None], "string", lambda c: scalars.truncate_utf8(c, 31)) == ["é" * 15, "a" * 31, "short", None]


def test_payload_gate(spark):
    texts = ["x" * n for n in (199, 200, 639, 640, 767, 768)]
    assert column(spark, texts, "string", quality.valid_payload) == [False, True, True, True, True, False]
    assert column(spark, texts, "string", quality.maybe_torn) == [False, False, False, True, True, True]


def test_heap(spark):
    assert column(spark, [14_999, 15_000, 20_479, 20_480], "long", quality.heap_class) == ["critical", "low", "low", "ok"]


def test_config(spark):
    rows = [(99.0, 0, 75, "x"), (100.0, 1, 50, "http://a"), (250.0, 60, 150, "https://a"), (251.0, 61, None, None)]
    out = quality.coerce_config(spark.createDataFrame(rows, "volt double, interval int, rating int, url string")).collect()
    assert [(r.volt, r.interval, r.rating) for r in out] == [(230.0, 1, 50), (100.0, 1, 50), (250.0, 60, 150), (230.0, 1, 50)]
    assert [r.url.startswith("http") for r in out] == [True] * 4
    filled = quality.fill_config(spark.createDataFrame([(None, None), (50, "CET")], "rating int, tz string")).collect()
    assert [tuple(r) for r in filled] == [(30, "UTC"), (50, "CET")]


def test_commands(spark):
    rows = [("set_interval", 0.0), ("set_interval", 61.0), ("set_interval", 1.0), ("set_interval", None), ("set_voltage", 100.0), ("set_voltage", 250.0), ("set_voltage", 250.5), ("reboot", None), ("dance", 1.0), ("", None), (None, None)]
    got = [r.accepted for r in quality.validate_commands(spark.createDataFrame(rows, "action string, value double")).collect()]
    assert got == [False, False, True, False, True, True, False, True, False, False, False]


def test_three_crash_sets(spark):
    codes = list(scalars.BOOT_LABELS)
    sets = {rule: {c for c, x in zip(codes, column(spark, codes, "string", lambda c: scalars.is_crash(c, rule))) if x} for rule in ("crash", "post_update", "unexpected")}
    assert sets["unexpected"] - sets["post_update"] == {"deepsleep"} and sets["crash"] == sets["post_update"]
    assert column(spark, ["other"], "string", lambda c: scalars.is_crash(c, "post_update")) == [True] and column(spark, ["other"], "string", scalars.is_crash) == [False]
    assert column(spark, ["other", "deepsleep"], "string", lambda c: scalars.boot_label(c, "heartbeat")) == ["unknown", "unknown"]


def test_outcomes(spark):
    codes = [200, 400, 422, 500, -1, None]
    assert column(spark, codes, "int", quality.route_outcome) == ["sent", "rejected", "clock_dropped", "retry", "retry", "retry"]
    assert column(spark, codes, "int", lambda c: quality.route_outcome(c, "bulk")) == ["done", "discarded", "discarded", "retry", "retry", "retry"]
    assert column(spark, [404, -11], "int", lambda c: scalars.failure_message(c, F.lit("timeout"))) == ["HTTP 404", "HTTP err: timeout"]
