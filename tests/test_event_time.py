"""State machines on event time: order, late rows, timers and expiry. The registered streams are held against their SQL in test_oracle."""

import random
import time

import pytest
from pyspark.sql import functions as F

from wattfleet.operators import sequences
from wattfleet.plans import stream_queries
from wattfleet.plans.stream_queries import appended
from wattfleet.streaming import event_time

S = 1_000_000
SCHEMA = "user string, us long, n long"


def slices(spark, *data, schema=SCHEMA):
    return [spark.createDataFrame(rows, schema).coalesce(1) for rows in data]


def tick(at):
    return [(None, at, None)]


@pytest.mark.parametrize("piece", [3, 1000])
def test_throttle_of_shuffled_rows(spark, monkeypatch, piece):
    monkeypatch.setattr(event_time, "PIECE", piece)
    rng = random.Random(piece)
    rows = [(u, (i * 10 + rng.randrange(10)) * S, i) for u, n in (("a", 60), ("b", 40)) for i in range(n)]
    rows += [(*rows[0][:2], 999)]  # a tie
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(90) * S)  # up to 90 s out of order
    parts = [late[:35], late[35:70], late[70:]]
    out = appended(spark, slices(spark, *parts, tick(10_000 * S)), lambda s: event_time.throttle_stream(s, "user", ["us", "n"], "us", 25 * S, "100 seconds"))
    got = sorted((r.user, r.us, r.n, r.kept) for r in out.collect())
    want = sequences.throttle(spark.createDataFrame(rows, SCHEMA), "user", ["us", "n"], "us", 25 * S)
    assert got == sorted((r.user, r.us, r.n, r.kept) for r in want.collect()) and len(got) == 101


def test_rows_wait_for_the_watermark(spark):
    out = lambda *parts: sorted((r.us // S, r.n) for r in appended(spark, slices(spark, *parts), lambda s: event_time.throttle_stream(s, "user", ["us", "n"], "us", S, "10 seconds")).collect())
    # the watermark is at 20 s: what is later waits, what comes behind it is dropped
    assert out([("a", 5 * S, 1), ("a", 30 * S, 2)]) == [(5, 1)]
    assert out([("a", 5 * S, 1), ("a", 30 * S, 2)], [("a", 7 * S, 3), ("a", 21 * S, 4)], [("b", 60 * S, 5)]) == [(5, 1), (21, 4), (30, 2)]


def test_state_of_silent_keys_expires(spark):
    build = lambda keep: lambda s: event_time.throttle_stream(s, "user", ["us", "n"], "us", 100 * S, "1 second", keep_us=keep)
    parts = [[("a", 1 * S, 1)], [("b", 60 * S, 2)], [("a", 70 * S, 3)], tick(500 * S)]
    kept = lambda keep: {r.n: r.kept for r in appended(spark, slices(spark, *parts), build(keep)).collect()}
    assert kept(None) == {1: True, 2: True, 3: False}
    # after 30 s of silence device a starts anew
    assert kept(30 * S) == {1: True, 2: True, 3: True}


def test_silence_is_told_while_it_lasts(spark):
    told = lambda *parts: sorted((r.user, r.silent_from // S) for r in appended(spark, slices(spark, *parts), lambda s: event_time.silence_stream(s, "user", "us", 30 * S, "5 seconds")).collect())
    first = [("a", 1 * S, 1), ("a", 20 * S, 2), ("b", 10 * S, 3)]
    assert told(first, [("b", 45 * S, 4)]) == []  # the watermark is at 40 s, b may still report at 40 s
    # time goes on by rows of c only: a and b are silent, and told once
    assert told(first, [("c", 60 * S, 4)], [("c", 80 * S, 5)], [("c", 100 * S, 6)]) == [("a", 20), ("b", 10)]
    # b comes back and stops again
    assert told(first, [("c", 60 * S, 4)], [("b", 90 * S, 5)], tick(300 * S)) == [("a", 20), ("b", 10), ("b", 90), ("c", 60)]
    # a row that comes late but in time fills the gap
    assert told([("a", 1 * S, 1), ("a", 34 * S, 2)], [("a", 30 * S, 3)], [("a", 50 * S, 4)]) == []


def test_configuration_by_versions(spark):
    schema = "user string, us long, event_id long, kind string, value double"
    rows = [("a", 5, 1, "config", 230.0), ("a", 10, 2, "boot", None), ("a", 20, 3, "config", 110.0), ("a", 25, 4, "reading", None), ("a", 30, 5, "boot", None), ("a", 30, 6, "reading", None), ("a", 1, 7, "reading", None), ("b", 9, 8, "reading", None)]
    rows = [(u, s * S, i, k, v) for u, s, i, k, v in rows]
    parts = [[rows[i] for i in (5, 3)], [rows[i] for i in (0, 4, 6)], [rows[i] for i in (7, 1, 2)], [("a", 200 * S, 9, "reading", None)], [(None, 400 * S, None, None, None)]]
    out = appended(spark, slices(spark, *parts, schema=schema), lambda s: event_time.config_in_force_stream(s, "user", "60 seconds"))
    got = {r.event_id: (r.booted_at and r.booted_at // S, r.config_at and r.config_at // S, r.config_value) for r in out.collect()}
    assert got == {4: (10, 5, 230.0), 6: (30, 20, 110.0), 7: (None, None, None), 8: (None, None, None), 9: (30, 20, 110.0)}


def test_commands_without_an_effect(spark):
    schema = "user string, us long, n long, kind string"
    rows = [("a", 10, 1, "c"), ("a", 15, 2, "w"), ("a", 18, 3, "w"), ("b", 10, 4, "c"), ("a", 40, 5, "c"), ("a", 60, 6, "w"), ("a", 61, 7, "c")]
    parts = [[(u, s * S, n, k) for u, s, n, k in rows[i : i + 3]] for i in (0, 3, 6)]

    def build(rows):
        rows = rows.withColumn("at", F.timestamp_micros("us"))
        side = lambda k: rows.filter((F.col("kind") == k) | F.col("user").isNull()).withColumnRenamed("n", "value" if k == "w" else "command")
        return event_time.command_effects_stream(side("c"), side("w"), "user", "command", 20, "30 seconds")

    out = appended(spark, slices(spark, *parts, *[[(None, s * S, None, None)] for s in (500, 900)], schema=schema), build).filter("command IS NOT NULL")
    assert {r.command: r.effect_value for r in out.collect()} == {1: 2, 4: None, 5: 6, 7: None}


def test_state_is_by_bucket(spark):
    # a call to the state store for each of many devices costs more than their rows
    event_time.rocksdb(spark)
    n = 6000
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", n).option("numPartitions", 2).option("advanceMillisPerBatch", 1000).load()
    rows = source.select((F.col("value") % n).alias("user"), (F.col("value") * S).alias("us"), F.col("value").alias("n"))
    out = event_time.throttle_stream(rows, "user", ["us", "n"], "us", S, "1 second")
    query = out.writeStream.format("noop").start()
    try:
        while not any(p.numInputRows for p in query.recentProgress):
            assert query.isActive
            time.sleep(0.2)
        held = max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.numInputRows)
    finally:
        query.stop()
    assert 0 < held < n


def test_batches_write_what_they_changed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "scratch", lambda _: str(tmp_path))
    schema = "user string, us long, n long, kind string"

    def build(rows):
        rows = rows.withColumn("at", F.timestamp_micros("us"))
        return event_time.command_effects_stream(rows.withColumnRenamed("n", "command"), rows.withColumnRenamed("n", "value"), "user", "command", 20, "30 seconds")

    appended(spark, slices(spark, [("a", 10 * S, 1, "c")], schema=schema), build)
    assert list((tmp_path / "state" / "state").rglob("*.changelog"))
