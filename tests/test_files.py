"""Files written and read again, where devices have more rows than one file or one limit."""

import datetime

from pyspark.sql import functions as F

from wattfleet import plans
from wattfleet.plans import join_queries


def write_events(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_limits_hold_per_device(spark, tmp_path):
    # 40 devices that 16 buckets would merge, with 5 errors and 35 sign-ups each
    at = datetime.datetime(2026, 1, 1)
    rows = [(u * 100 + i, u, at + datetime.timedelta(seconds=i), "error" if i < 5 else "signup", 1.0, "{}") for u in range(40) for i in range(40)]
    out = plans.QUERIES["file_ingest_by_device"](spark, write_events(spark, tmp_path, rows))
    n = {r["kind"]: r["n"] for r in out.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert n == {"readings": 1600, "rejected": 200, "errors": 200, "buffer": 1200}


def test_offline_files_go_on(spark, tmp_path):
    # one user with more readings than a file holds; the next file starts at its own first reading
    at = datetime.datetime(2026, 1, 1)
    rows = [(i, 7, at + datetime.timedelta(seconds=2 * i), "click", float(i % 500), "{}") for i in range(40_025)]
    out = plans.QUERIES["ls01_decode"](spark, write_events(spark, tmp_path, rows)).filter("channel = 1")
    assert out.agg(F.count("*"), F.count_distinct("seq"), F.min("seq"), F.max("seq")).first()[:] == (40_025, 40_025, 0, 40_024)
    epoch = int(at.replace(tzinfo=datetime.timezone.utc).timestamp())
    got = {r.seq: (r["at"], r.amps) for r in out.filter("seq IN (39999, 40000, 40024)").collect()}
    assert {s: a for s, (a, _) in got.items()} == {39_999: epoch + 39_999, 40_000: epoch + 80_000, 40_024: epoch + 80_024}
    assert all(abs(amps - (0.0123 * (s % 500) + 0.13)) < 0.0011 for s, (_, amps) in got.items())


def test_offline_files_in_bundles(spark, tmp_path, monkeypatch):
    # a file on storage for each of 300 devices would cost more than their readings
    monkeypatch.setattr(join_queries, "scratch", lambda _: str(tmp_path / "written"))
    at = datetime.datetime(2026, 1, 1)
    rows = [(u * 100 + i, u, at + datetime.timedelta(seconds=i), "click", float(i), "{}") for u in range(300) for i in range(25)]
    out = plans.QUERIES["ls01_files"](spark, write_events(spark, tmp_path / "table", rows)).filter("channel = 1")
    n = {r.device_id: r["count"] for r in out.groupBy("device_id").count().collect()}
    # of users with a wrong magic there is nothing, of files that are cut off the last block is missing
    assert n == {str(u): 20 if u % 7 == 3 else 25 for u in range(300) if u % 11 != 5}
    assert len(list((tmp_path / "written").rglob("part-*"))) <= 30
