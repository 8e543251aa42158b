"""Recurrences against plain folds, streams against batches, offline files against what was written."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from wattfleet.operators import aggregates, history, joins, sequences
from wattfleet.sources import ingest, ls01
from wattfleet.streaming import streams


def frame(spark, values, schema="d string, i long, x long"):
    return spark.createDataFrame(values, schema)


def test_throttle(spark):
    df = frame(spark, [("a", i, x) for i, x in enumerate([10, 30, 50, 60, 89, 90])])
    got = [r.x for r in sequences.throttle(df, "d", ["i"], "x", 30, anchor=0).filter("kept").orderBy("i").collect()]
    assert got == [30, 60, 90]


def test_phase_slots(spark):
    df = frame(spark, [("a", i, x) for i, x in enumerate([1000, 2100, 5500, 6400, 6600])])
    got = [(r.slot, r.resynced) for r in sequences.phase_slots(df, "d", ["i"], "x", 1000).orderBy("i").collect()]
    assert got == [(1000, False), (2000, False), (5500, True), (None, False), (6500, False)]


def test_stability(spark):
    again = [("d", k) for k in ("update", "panic", "panic", "update", "panic", "panic", "sw")]  # an update counts crashes anew
    rows = [("a", "update"), ("a", "panic"), ("a", "panic"), ("a", "panic"), ("b", "update"), ("b", "sw"), ("c", "panic"), *again]
    df = frame(spark, [(d, i, k) for i, (d, k) in enumerate(rows)], "d string, i long, k string").withColumns({"u": F.col("k") == "update", "c": F.col("k") == "panic"})
    got = [r.verdict for r in sequences.update_stability(df, "d", ["i"], "u", "c").orderBy("i").collect()]
    assert got == [None, "crash", "crash", "rollback", None, "stable", None, None, "crash", "crash", None, "crash", "crash", "stable"]


def test_outage_grace(spark):
    rows = [("a", 0, "down"), ("a", 30_000, "other"), ("a", 30_001, "other"), ("a", 40_000, "up"), ("a", 41_000, "ok"), ("a", 42_000, "uploaded")] + [("b", i, "fail") for i in range(5)]
    df = frame(spark, rows, "d string, i long, k string")
    got = [r.state for r in sequences.connection_state(df, "d", ["i"], "i", "k", 30_000).orderBy("d", "i").collect()]
    assert got == ["grace", "grace", "offline", "offline", "upload_pending", "online"] + ["online"] * 4 + ["offline"]


def test_random_folds(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), i, rng.randrange(0, 40) + 20 * i) for i in range(1000)]
    got = {r.i: (r.kept, r.slot) for r in sequences.phase_slots(sequences.throttle(frame(spark, rows).repartition(5), "d", ["i"], "x", 300), "d", ["i"], "x", 500).collect()}
    for d in "abc":
        last, slot = None, 0
        for _, i, x in (r for r in rows if r[0] == d):
            keep = last is None or x - last >= 300
            last = x if keep else last
            due = None
            if x - slot >= 500:
                slot = due = x if x - slot - 500 > 500 else slot + 500
            assert got[i] == (keep, due)


def test_crash_counter(spark):
    codes = ["poweron", "panic", "sw", "brownout", "poweron", "wdt"]
    df = frame(spark, [("a", i, c) for i, c in enumerate(codes)], "d string, i long, c string")
    out = aggregates.crash_count(df, "d", ["i"], F.col("c").isin("panic", "brownout", "wdt"), F.col("c") == "poweron").orderBy("i").collect()
    assert [r.crash_count for r in out] == [0, 1, 1, 2, 0, 1]


def test_signal(spark):
    for values, want in ([-61], (-61, -61)), ([-61, -62], (-62, -61)), ([5, 6], (0, 5)), ([None, -7], (-7, -7)):
        df = frame(spark, [("a", i, x) for i, x in enumerate(values)])
        r = sequences.rolling_signal(df, "d", ["i"], "x").orderBy(F.desc("i")).first()
        assert (r.rolling_min, r.rolling_avg) == want


def ls01_file(path, blocks, epoch=1_700_000_000, device=b"dev-1", magic=b"LS01"):
    """blocks: (readings of six milliamps, raw?)"""
    data = magic + device.ljust(32, b"\0") + struct.pack("<I", epoch)
    for rows, raw in blocks:
        body = b"".join(struct.pack("<6h", *r) for r in rows)
        if not raw:
            c = zlib.compressobj(wbits=-15)
            body = c.compress(body) + c.flush()
        data += struct.pack("<H", len(body) | (0x8000 if raw else 0)) + body
    path.write_bytes(data)
    return data


@pytest.fixture
def offline(tmp_path):
    rows = [[100 * i + c for c in range(6)] for i in range(24)] + [[-15038, 130, 130, 130, 130, 130]]
    ls01_file(tmp_path / "good.dat", [(rows[:10], False), (rows[10:20], True), (rows[20:], False)])
    ls01_file(tmp_path / "unsynced.dat", [(rows[:3], True)], epoch=0)
    ls01_file(tmp_path / "bad.dat", [(rows[:3], True)], magic=b"XX01")
    (tmp_path / "empty.dat").write_bytes(b"LS01" + b"\0" * 36)
    whole = ls01_file(tmp_path / "cut.dat", [(rows[:10], True), (rows[10:20], True)])
    (tmp_path / "cut.dat").write_bytes(whole[:-5])
    return tmp_path


def test_ls01(spark, offline):
    files, blocks = ls01.read_ls01(spark, str(offline))
    assert {r.path.rsplit("/", 1)[1]: r.status for r in files.collect()} == {"good.dat": "ok", "unsynced.dat": "ok", "cut.dat": "ok", "bad.dat": "bad_magic", "empty.dat": "empty"}
    good = blocks.filter("path LIKE '%good.dat'")
    assert [(r.readings, r.raw) for r in good.orderBy("block").collect()] == [(10, False), (10, True), (5, False)]
    rows = ls01.offline_readings(good).orderBy("seq", "channel").collect()
    assert len(rows) == 150 and [r.ts.timestamp() - 1_700_000_000 for r in rows[::6]] == list(range(25))
    assert rows[144].ma_wrapped and rows[144].amps == 50.498 and rows[13].amps == 0.201 and rows[0].device_id == "dev-1"
    assert {r.ts_quality for r in ls01.offline_readings(blocks.filter("path LIKE '%unsynced.dat'")).collect()} == {"unsynced"}
    assert [(r.readings, r.damaged) for r in blocks.filter("path LIKE '%cut.dat'").orderBy("block").collect()] == [(10, False), (0, True)]
    roll = aggregates.offline_rollup(good).first()
    assert roll.readings == 25 and roll.blocks == 3 and roll.file_bytes == (offline / "good.dat").stat().st_size


def test_merge_prefers_live(spark):
    live = spark.createDataFrame([("d", 1, 2.0, 230.0, 414.0)], "device_id string, seq int, amps double, voltage double, watts double")
    offline = spark.createDataFrame([("d", 1, 2.0, 230.0), ("d", 2, 1.0, 230.0)], "device_id string, seq int, amps double, voltage double")
    out = history.dedupe_readings(history.merge_readings(live, live, offline), ["device_id", "seq", "amps"], ["watts"]).orderBy("seq").collect()
    assert [(r.origin, r.deliveries, round(r.watts, 6)) for r in out] == [("live", 3, 414.0), ("offline", 1, 207.0)]


def test_config_takes_effect_at_boot(spark):
    t = lambda s: f"2024-01-01 00:00:{s:02d}"
    config = spark.createDataFrame([("d", t(5), 1, 230.0), ("d", t(20), 2, 110.0)], "d string, ts string, n int, volt double").withColumn("ts", F.to_timestamp("ts"))
    boots = spark.createDataFrame([("d", t(1)), ("d", t(10)), ("d", t(30))], "d string, ts string").withColumn("ts", F.to_timestamp("ts"))
    readings = spark.createDataFrame([("d", t(2)), ("d", t(15)), ("d", t(25)), ("d", t(30)), ("e", t(9))], "d string, ts string").withColumn("ts", F.to_timestamp("ts"))
    out = joins.enrich_as_of(readings, boots, config, "d", "ts", ["volt"], "n").orderBy("d", "ts").collect()
    assert [r.volt for r in out] == [None, 230.0, 230.0, 110.0, None]


def test_commands_and_errors(spark, tmp_path):
    batch = '{"commands":[' + ",".join(['{"action":""}'] + ['{"action":"reboot"}'] * 10) + "]}"
    df = spark.createDataFrame([(1, batch), (2, "junk"), (3, '{"commands":[{"action":"set_interval","value":5}]}')], "id int, body string")
    assert [(r.id, r.n) for r in ingest.parse_commands(df, "body", ["id"]).groupBy("id").agg(F.count("*").alias("n")).orderBy("id").collect()] == [(1, 10), (3, 1)]
    (tmp_path / "errors.json").write_text("[" + ",".join(['{"t":"x"}'] * 40) + "]")
    (tmp_path / "broken.json").write_text("[{")
    out = ingest.read_error_logs(spark, str(tmp_path)).collect()
    assert len(out) == 30 and {(r.timestamp, r.message) for r in out} == {("x", "")}


def run_stream(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_live_totals(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_id", "ts", "value")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("user_id long, event_id long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    got = run_stream(spark, streams.live_totals(source, "ts", "1 hour", "1 day", "user_id", "value"), "s_totals", "append")
    closed = events.agg(F.date_trunc("day", F.max("ts") - F.expr("INTERVAL 1 HOUR"))).first()[0]
    want = streams.live_totals(events, "ts", "1 hour", "1 day", "user_id", "value").filter(F.col("window_start") < closed)
    assert sorted((str(r.window_start), r.user_id, r.n) for r in got.collect()) == sorted((str(r.window_start), r.user_id, r.n) for r in want.collect())


def test_best_offer_of_one_catalogue(spark):
    checks = spark.createDataFrame([(1, "1.0"), (2, "2.10"), (3, "3.0")], "id int, v string")
    releases = spark.createDataFrame([("2.9",), ("2.10",), ("1.5",)], "r string")
    assert sorted((r.id, r.offered) for r in joins.best_offer(checks, releases, "v", "r", []).collect()) == [(1, "2.10")]
