"""Stores that several jobs write to: appends with a cap, snapshots, increments, batches that are repeated."""

import os
import random

import pytest
from pyspark.sql import functions as F

from wattfleet.functions import quality
from wattfleet.operators import aggregates
from wattfleet.sources import ls01, stores
from wattfleet.streaming.late import LateRows, write_readings_batch, write_readings_stream

DAY = 86_400_000_000


def rows(df):
    return sorted(map(str, df.collect()))


def test_capped_appends(spark, tmp_path):
    rng = random.Random(5)
    data = [("abc"[i % 3] if i % 17 else None, i, "é" * rng.randrange(0, 400) if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(data, "k string, i int, t string")
    once = quality.dead_letter(df, "k", "i", "t", 9000).select("k", "i", "bytes_before")
    path = str(tmp_path / "logs")
    # an empty batch, and one that is repeated after a later one has been written
    for batch, (a, b) in enumerate([(0, 0), (0, 50), (50, 51), (51, 300), (300, 400)]):
        for _ in range(1 + batch % 2):
            stores.write_dead_letters(df.filter((F.col("i") >= a) & (F.col("i") < b)), path, "k", "i", "t", batch, 9000)
    assert rows(stores.read_dead_letters(spark, path).select("k", "i", "bytes_before")) == rows(once) and once.count() < 400
    stores.write_dead_letters(df.filter("i >= 50 AND i < 51"), path, "k", "i", "t", 2, 9000)
    assert rows(stores.read_dead_letters(spark, path).select("k", "i", "bytes_before")) == rows(once)


def test_cap_is_tested_before_a_row(spark, tmp_path):
    df = spark.createDataFrame([("d", i, "x" * 30_000) for i in range(4)], "k string, i int, t string")
    for i in range(4):
        stores.write_dead_letters(df.filter(F.col("i") == i), str(tmp_path / "dead"), "k", "i", "t", i)
    assert stores.read_dead_letters(spark, str(tmp_path / "dead")).count() == 2


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    first = stores.publish_snapshot(spark.range(5), path)
    before = stores.read_snapshot(spark, path)
    second = stores.publish_snapshot(spark.range(7), path)
    # who resolved the pointer before still reads the old table
    assert before.count() == 5 and stores.read_snapshot(spark, path).count() == 7 and first != second
    bad = spark.range(9).select(F.when(F.col("id") > 7, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        stores.publish_snapshot(bad, path)
    assert stores.read_snapshot(spark, path).count() == 7
    stores.publish_snapshot(spark.range(1), path)
    stores.publish_snapshot(spark.range(2), path)
    assert stores.read_snapshot(spark, path).count() == 2
    assert [n for n in os.listdir(path) if n.startswith("v-")] and first not in os.listdir(path)


def test_readers_never_see_half(spark, tmp_path):
    path, seen = str(tmp_path / "snap"), set()
    stores.publish_snapshot(spark.range(100), path)
    real = stores.replace_small
    try:
        def slow(*a):  # all is written, the pointer not yet
            seen.add(stores.read_snapshot(spark, path).count())
            real(*a)

        stores.replace_small = slow
        stores.publish_snapshot(spark.range(300), path)
    finally:
        stores.replace_small = real
    assert seen == {100} and stores.read_snapshot(spark, path).count() == 300


@pytest.mark.parametrize("seed", [1, 2])
def test_calibration_increments(spark, tmp_path, seed):
    rng = random.Random(seed)
    data = [(rng.choice("pq"), rng.randrange(-1, 7), rng.randrange(0, 4), float(rng.randrange(100)), i) for i in range(600)]
    df = spark.createDataFrame(data, "d string, channel int, point int, mv double, n int")
    want = aggregates.calibration_points(df, "channel", "point", "mv", "n", ("d",), group=70)
    path, parts = str(tmp_path / "points"), list(range(4))
    rng.shuffle(parts)
    for p in [99, *parts]:  # the first is empty
        stores.upsert_calibration(df.filter(F.floor(F.col("n") / 31) % 4 == p), path, "channel", "point", "mv", "n", ("d",), group=70, buckets=5)
    key = lambda t: sorted((r.d, r.channel, r.point, round(r.mean_value, 9), r.recorded_at, r.n_samples) for r in t.collect())
    assert key(stores.read_calibration(spark, path, ["d", "channel", "point"])) == key(want)


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "points")
    df = spark.createDataFrame([(c, p, 1.0, 0) for c in range(6) for p in range(3)], "channel int, point int, mv double, n int")
    stores.upsert_calibration(df, path, "channel", "point", "mv", "n", buckets=8)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    stores.upsert_calibration(df.filter("channel = 2 AND point = 1").withColumn("n", F.lit(501)), path, "channel", "point", "mv", "n", buckets=8)
    gone, new = before - files(), files() - before
    assert {os.path.dirname(f) for f in gone} == {os.path.dirname(f) for f in new} and len({os.path.dirname(f) for f in new}) == 1 and before & files()
    assert {(r.channel, r.point): r.recorded_at for r in stores.read_calibration(spark, path, ["channel", "point"]).collect()}[2, 1] == 501


def test_sides(spark, tmp_path):
    df = spark.createDataFrame([(1, "1970-01-01T00:00:00.000Z"), (2, "2026-01-01T00:00:00.000Z"), (3, None), (4, "0")], "i int, timestamp string")
    path = str(tmp_path / "sides")
    for _ in range(2):
        stores.write_sides(quality.mark_unsynced(df), path, "side")
    assert [r.i for r in spark.read.parquet(path).filter("side = 'bad'").orderBy("i").collect()] == [1, 3, 4] and spark.read.parquet(path).count() == 4
    good, bad = quality.quarantine_unsynced(df)
    assert [r.i for r in good.collect()] == [2] and bad.count() == 3


def test_readings_are_written_once(spark, tmp_path, monkeypatch):
    from wattfleet.streaming import late

    src, path = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(30).select("id", F.timestamp_seconds(F.col("id") * 10_000).alias("ts"))
    df.coalesce(1).write.parquet(src)
    run = lambda: write_readings_stream(spark.readStream.schema("id long, ts timestamp").parquet(src), path, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    real = late.write_readings_batch

    def killed(*a):  # the rows are written, the batch isn't committed
        real(*a)
        raise RuntimeError("killed")

    monkeypatch.setattr(late, "write_readings_batch", killed)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(late, "write_readings_batch", real)
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(30))
    write_readings_batch(df, 0, path)
    assert spark.read.parquet(path).count() == 30


def late_store(path):
    return LateRows(path, "us", DAY, lambda rows: rows.groupBy("user", "day").agg(F.count("*").alias("n"), F.sum("v").alias("total")))


def test_late_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    store = late_store(path)
    row = lambda user, day, v: (user, int(day * DAY), v)
    make = lambda data: spark.createDataFrame(data, "user int, us long, v int")
    batches = [
        [row(1, 100.1, 1), row(2, 100.9, 2), row(1, 101.5, 3), row(1, 104.2, 4)],  # watermark 103.2
        [row(2, 100.2, 5), row(2, 103.3, 6), row(1, 103.1, 7)],  # 100.2 is late for a closed day, 103.1 for an open one
        [],
        [row(1, 107.0, 8), (3, None, 9)],
    ]
    store.add(make(batches[0]), 0)
    files = lambda day: {f for f in os.listdir(f"{path}/daily/day={day}") if f.endswith(".parquet")}
    assert sorted(d for d in os.listdir(f"{path}/daily") if d.startswith("day=")) == ["day=100", "day=101"]
    untouched, touched = files(101), files(100)
    store.add(make(batches[1]), 1)
    assert files(101) == untouched and files(100) != touched
    late = lambda: sorted((r.user, r.v, r.batch) for r in store.late(spark).collect())
    assert late() == [(1, 7, 1), (2, 5, 1)]
    store.add(make(batches[1]), 1)  # repeated
    store.add(make(batches[2]), 2)
    store.add(make(batches[3]), 3)
    assert late() == [(1, 7, 1), (2, 5, 1), (3, 9, 3)]
    # a store is all in its folder: another object goes on with it
    late_store(path).finish(spark)
    once = make([r for b in batches for r in b if r[1] is not None]).withColumn("day", store.day())
    assert rows(store.daily(spark).select("user", "day", "n", "total")) == rows(store.build(once).select("user", F.col("day").cast("int"), "n", "total"))


def test_offline_files(spark, tmp_path):
    import struct
    import zlib

    def block(values, raw):
        body = struct.pack(f"<{len(values)}h", *values)
        if not raw:
            c = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = c.compress(body) + c.flush()
        return struct.pack("<H", len(body) | (0x8000 if raw else 0)) + body

    head = lambda name, epoch: b"LS01" + name.encode().ljust(32, b"\0") + struct.pack("<I", epoch)
    mixed = head("a", 1000) + block(list(range(60)), True) + block([7] * 60, False) + block([9] * 30, False)
    broken = head("b", 2000) + block([1] * 60, False) + struct.pack("<H", 20) + b"\xff" * 20 + block([2] * 60, True)
    capped = head("c", 0) + block([3] * 60, True) * 4600
    for name, content in {"mixed": mixed, "broken": broken, "capped": capped, "cut": mixed[:-1], "magic": b"LS00" + mixed[4:], "empty": head("e", 1)}.items():
        (tmp_path / name).write_bytes(content)
    files, blocks = ls01.read_ls01(spark, str(tmp_path))
    status = {r.path.rsplit("/", 1)[1]: (r.status, r.capped) for r in files.collect()}
    assert status == {"mixed": ("ok", False), "broken": ("ok", False), "capped": ("ok", True), "cut": ("ok", False), "magic": ("bad_magic", False), "empty": ("empty", False)}
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    got = {}
    for r in blocks.select(name, "block", "first_seq", "readings", "raw", "damaged", "device_id", "start_epoch").orderBy("name", "block").collect():
        got.setdefault(r.name, []).append(tuple(r)[1:6])
    assert got["mixed"] == [(0, 0, 10, True, False), (1, 10, 10, False, False), (2, 20, 5, False, False)]
    assert got["cut"][:2] == got["mixed"][:2] and got["cut"][2][1:] == (20, 0, False, True)
    assert got["broken"] == [(0, 0, 10, False, False), (1, 10, 0, False, True)] and len(got["capped"]) == 4600
    out = ls01.offline_readings(blocks.filter("NOT damaged"), interval_s=2)
    assert out.filter("device_id = 'a' AND path LIKE '%mixed'").agg(F.count("*"), F.max("seq")).first()[:] == (150, 24)
    assert out.filter("device_id = 'c'").select("ts_quality").distinct().first()[0] == "unsynced"
