"""Window, island and recurrence queries."""

from pyspark.sql import functions as F

from wattfleet.operators import joins, sequences
from wattfleet.plans.registry import CODE_SQL, ORDER, code, events, micros, query
from wattfleet.streaming import streams

HOUR = 3_600_000_000
#: What an event type plays on a link.
KIND_SQL = "CASE event_type WHEN 'click' THEN 'up' WHEN 'view' THEN 'ok' WHEN 'signup' THEN 'reply' WHEN 'purchase' THEN 'down' ELSE 'fail' END"
_RUNS = f"""
    c AS (SELECT *, {CODE_SQL} AS code FROM events),
    i AS (SELECT *, count(*) FILTER (code = 200) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c),
    r AS (SELECT *, count(*) FILTER (code = 500) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM i)"""
_NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) AS us FROM events)"


@query("""
    SELECT event_id, least(0, min(v) OVER w) AS rolling_min, CAST(sum(v) OVER w AS BIGINT) // count(*) OVER w AS rolling_avg
    FROM (SELECT *, -CAST(trunc(value) AS BIGINT) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 59 PRECEDING)""")
def rolling_signal(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("v", -F.col("value").cast("long"))
    return sequences.rolling_signal(e, "user_id", ORDER, "v").select("event_id", "rolling_min", "rolling_avg")


@query("""
    SELECT event_id, user_id, newest, greatest(n - 30, 0) AS displaced FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS newest, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE newest <= 30""")
def keep_latest_30(spark, sf_dir):
    return sequences.keep_latest(events(spark, sf_dir), "user_id", ORDER, 30).select("event_id", "user_id", "newest", "displaced")


@query("SELECT event_id, user_id, nth FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth FROM events) WHERE nth <= 10")
def first_n(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return sequences.first_n(e, ["user_id", "day"], ORDER, 10).select("event_id", "user_id", "nth")


@query("SELECT event_id, user_id, nth FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events) WHERE nth % 10 = 0")
def every_10th(spark, sf_dir):
    return sequences.every_nth(events(spark, sf_dir), "user_id", ORDER, 10).select("event_id", "user_id", "nth")


@query("""
    SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS replay FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 30 GROUP BY user_id""")
def oldest_first(spark, sf_dir):
    out = sequences.oldest_first(events(spark, sf_dir), "user_id", ORDER, ["event_id"])
    return out.select("user_id", F.array_join(F.transform("rows", lambda r: r["event_id"].cast("string")), ",").alias("replay"))


def _runs(spark, sf_dir):
    return sequences.failure_runs(events(spark, sf_dir).withColumn("http_code", code()), "user_id", ORDER, F.col("http_code") == 500, F.col("http_code") == 200)


@query(f"WITH {_RUNS} SELECT event_id, run, code = 500 AND run = 1 AS first_of_run FROM r")
def failure_runs(spark, sf_dir):
    return _runs(spark, sf_dir).select("event_id", "run", "first_of_run")


@query(f"WITH {_RUNS} SELECT event_id, CASE run WHEN 0 THEN 1000 WHEN 1 THEN 2000 WHEN 2 THEN 4000 ELSE 5000 END AS backoff_ms FROM r")
def backoff(spark, sf_dir):
    return sequences.with_backoff(_runs(spark, sf_dir)).select("event_id", "backoff_ms")


@query(f"WITH {_RUNS} SELECT event_id, user_id, ts FROM r WHERE code = 500 AND run = 5")
def stalls(spark, sf_dir):
    return sequences.stalls(_runs(spark, sf_dir), F.col("http_code") == 500).select("event_id", "user_id", "ts")


@query("""
    SELECT event_id, user_id, CASE WHEN up THEN 'up' ELSE 'down' END AS edge FROM (SELECT *, event_type <> 'error' AS up, coalesce(lag(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id), FALSE) AS was FROM events) WHERE up <> was""")
def edges(spark, sf_dir):
    return sequences.edges(events(spark, sf_dir), "user_id", ORDER, F.col("event_type") != "error").select("event_id", "user_id", "edge")


@query("""
    WITH f AS (SELECT *, event_type NOT IN ('error', 'purchase') AS up FROM events),
    g AS (SELECT *, count(*) FILTER (up) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ups FROM f),
    d AS (SELECT user_id, ups, min(ts) AS outage_start, count(*) AS rows FROM g WHERE NOT up GROUP BY ALL),
    u AS (SELECT user_id, ups - 1 AS ups, ts AS outage_end FROM g WHERE up)
    SELECT d.user_id, d.rows, outage_start, outage_end, round((epoch_us(outage_end) - epoch_us(outage_start)) / 1e6, 3) AS duration_s,
           coalesce((epoch_us(outage_end) - epoch_us(outage_start)) / 1e6 > 21600, FALSE) AS beyond_grace FROM d LEFT JOIN u USING (user_id, ups)""")
def outages(spark, sf_dir):
    out = sequences.outages(events(spark, sf_dir), "user_id", "ts", ORDER, ~F.col("event_type").isin("error", "purchase"), 21_600)
    return out.withColumn("duration_s", F.round("duration_s", 3))


_SESSIONS = """
    WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
    s AS (SELECT *, count(*) FILTER (prev IS NULL OR ts >= prev + INTERVAL 6 HOUR) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM l)
    SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS reports FROM s GROUP BY user_id, session"""


@query(_SESSIONS)
def sessions_6h(spark, sf_dir):
    return streams.silent_devices(events(spark, sf_dir), "user_id", "ts", "6 hours")


@query(f"""
    WITH x AS ({_SESSIONS.replace("6 HOUR", "24 HOUR")}), y AS (SELECT *, lead(first_seen) OVER (PARTITION BY user_id ORDER BY first_seen) AS back FROM x)
    SELECT user_id, last_seen AS silent_from, back AS silent_to FROM y WHERE back IS NOT NULL""")
def silent_users(spark, sf_dir):
    from pyspark.sql import Window

    s = streams.silent_devices(events(spark, sf_dir), "user_id", "ts", "24 hours")
    out = s.withColumn("silent_to", F.lead("first_seen").over(Window.partitionBy("user_id").orderBy("first_seen")))
    return out.filter("silent_to IS NOT NULL").select("user_id", F.col("last_seen").alias("silent_from"), "silent_to")


@query("""
    WITH c AS (SELECT *, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, cycle ORDER BY ts, event_id) AS retry FROM c WHERE event_type = 'error' AND cycle > 0)
    SELECT event_id, cycle, retry, retry = 3 AS exhausted FROM r WHERE retry <= 3""")
def retry_cycles(spark, sf_dir):
    t = F.col("event_type")
    return sequences.retry_cycles(events(spark, sf_dir), "user_id", ORDER, t == "click", t == "error").select("event_id", "cycle", "retry", "exhausted")


@query(f"""
    WITH c AS (SELECT *, {CODE_SQL} IN (200, 400, 422) AS done FROM events),
    s AS (SELECT *, coalesce(count(*) FILTER (done) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session FROM c)
    SELECT user_id, session, count(*) AS attempts, min(ts) AS session_start, max(ts) AS session_end, bool_or(done) AS finished FROM s GROUP BY ALL""")
def upload_sessions(spark, sf_dir):
    return sequences.upload_sessions(events(spark, sf_dir), "user_id", ORDER, "ts", code().isin(200, 400, 422))


@query(f"""
    WITH RECURSIVE {_NUMBERED}, f(user_id, k, event_id, last, kept) AS (
        SELECT user_id, k, event_id, us, TRUE FROM n WHERE k = 1
        UNION ALL SELECT n.user_id, n.k, n.event_id, CASE WHEN n.us - f.last >= {24 * HOUR} THEN n.us ELSE f.last END, n.us - f.last >= {24 * HOUR} FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1)
    SELECT event_id, kept FROM f""")
def throttle_1d(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "ts", micros().alias("us"))
    return sequences.throttle(e, "user_id", ORDER, "us", 24 * HOUR).select("event_id", "kept")


_START = 1_704_067_200_000_000


@query(f"""
    WITH RECURSIVE {_NUMBERED}, s AS (SELECT user_id, 0 AS k, CAST(NULL AS BIGINT) AS event_id, {_START} AS last, CAST(NULL AS BIGINT) AS slot, FALSE AS resynced FROM n WHERE k = 1),
    f AS (SELECT user_id, k, event_id, last, slot, resynced FROM s UNION ALL
        SELECT n.user_id, n.k, n.event_id,
               CASE WHEN n.us - f.last < {6 * HOUR} THEN f.last WHEN n.us - (f.last + {6 * HOUR}) > {6 * HOUR} THEN n.us ELSE f.last + {6 * HOUR} END,
               CASE WHEN n.us - f.last < {6 * HOUR} THEN NULL WHEN n.us - (f.last + {6 * HOUR}) > {6 * HOUR} THEN n.us ELSE f.last + {6 * HOUR} END,
               n.us - f.last >= {6 * HOUR} AND n.us - (f.last + {6 * HOUR}) > {6 * HOUR}
        FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1)
    SELECT event_id, slot, resynced FROM f WHERE k > 0""")
def phase_slots_6h(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "ts", micros().alias("us"))
    return sequences.phase_slots(e, "user_id", ORDER, "us", 6 * HOUR, _START).select("event_id", "slot", "resynced")


@query(f"""
    WITH RECURSIVE {_NUMBERED}, s AS (SELECT user_id, 0 AS k, CAST(NULL AS BIGINT) AS event_id, FALSE AS fresh, 0 AS crashes, CAST(NULL AS VARCHAR) AS verdict FROM n WHERE k = 1),
    f AS (SELECT user_id, k, event_id, fresh, crashes, verdict FROM s UNION ALL
        SELECT n.user_id, n.k, n.event_id,
               CASE WHEN n.event_type = 'signup' THEN TRUE WHEN NOT f.fresh THEN FALSE WHEN n.event_type <> 'error' THEN FALSE ELSE f.crashes + 1 < 3 END,
               CASE WHEN n.event_type = 'signup' THEN 0 WHEN NOT f.fresh THEN f.crashes WHEN n.event_type <> 'error' OR f.crashes + 1 >= 3 THEN 0 ELSE f.crashes + 1 END,
               CASE WHEN n.event_type = 'signup' OR NOT f.fresh THEN NULL WHEN n.event_type <> 'error' THEN 'stable' WHEN f.crashes + 1 >= 3 THEN 'rollback' ELSE 'crash' END
        FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1)
    SELECT event_id, verdict FROM f WHERE k > 0""")
def update_stability(spark, sf_dir):
    t = F.col("event_type")
    e = events(spark, sf_dir).select("event_id", "user_id", "ts", (t == "signup").alias("updated"), (t == "error").alias("crashed"))
    return sequences.update_stability(e, "user_id", ORDER, "updated", "crashed").select("event_id", "verdict")


@query(f"""
    WITH RECURSIVE n AS (SELECT *, {KIND_SQL} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) AS us FROM events),
    s AS (SELECT user_id, 0 AS k, CAST(NULL AS BIGINT) AS event_id, FALSE AS off, CAST(NULL AS BIGINT) AS since, 0 AS run, FALSE AS pending FROM n WHERE k = 1),
    f AS (SELECT user_id, k, event_id, off, since, run, pending FROM s UNION ALL
        SELECT user_id, k, event_id,
               CASE WHEN kind = 'fail' AND run + 1 >= 2 THEN TRUE WHEN kind IN ('ok', 'reply') THEN FALSE ELSE was END,
               CASE WHEN kind = 'down' THEN coalesce(since, us) WHEN kind IN ('up', 'ok', 'reply') THEN NULL ELSE since END,
               CASE WHEN kind = 'fail' THEN CASE WHEN run + 1 >= 2 THEN 1 ELSE run + 1 END WHEN kind = 'ok' OR (kind = 'reply' AND was) THEN 0 ELSE run END,
               pending OR (kind IN ('ok', 'reply') AND was)
        FROM (SELECT n.user_id, n.k, n.event_id, n.kind, n.us, f.since, f.run, f.pending, f.off OR coalesce(n.us - f.since > {6 * HOUR}, FALSE) AS was FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1))
    SELECT event_id, CASE WHEN off THEN 'offline' WHEN since IS NOT NULL THEN 'grace' WHEN pending THEN 'upload_pending' ELSE 'online' END AS state FROM f WHERE k > 0""")
def connection_state(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "ts", micros().alias("us"), F.expr(KIND_SQL).alias("kind"))
    return sequences.connection_state(e, "user_id", ORDER, "us", "kind", 6 * HOUR, failures=2).select("event_id", "state")


@query("""
    WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
    g AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS missed FROM d GROUP BY user_id)
    SELECT user_id, missed::VARCHAR AS missed FROM g ANTI JOIN d ON d.user_id = g.user_id AND d.day = g.missed""")
def missed_days(spark, sf_dir):
    return joins.missed_slots(events(spark, sf_dir).withColumn("day", F.to_date("ts")), "user_id", "day").withColumn("missed", F.col("missed").cast("string"))


@query("""
    WITH d AS (SELECT DISTINCT user_id, epoch_us(ts) // 21600000000 AS slot FROM events),
    g AS (SELECT user_id, unnest(range(min(slot), max(slot) + 1)) AS slot FROM d GROUP BY user_id)
    SELECT user_id, slot * 21600 AS missed_at FROM g ANTI JOIN d USING (user_id, slot)""")
def missed_6h(spark, sf_dir):
    return joins.missed_intervals(events(spark, sf_dir), "user_id", "ts", 21_600)


@query(f"""
    WITH RECURSIVE {_NUMBERED}, s AS (SELECT user_id, 0 AS k, CAST(NULL AS BIGINT) AS event_id, 0 AS cycle, CAST(NULL AS BIGINT) AS last, 0 AS tries, FALSE AS hit FROM n WHERE k = 1),
    f AS (SELECT user_id, k, event_id, cycle, last, tries, hit FROM s UNION ALL
        SELECT user_id, k, event_id, cycle + (t = 'click')::INT, CASE WHEN t = 'click' OR due THEN us ELSE last END, CASE WHEN t = 'click' THEN 0 WHEN due THEN tries + 1 ELSE tries END, due
        FROM (SELECT n.user_id, n.k, n.event_id, n.us, n.event_type AS t, f.cycle, f.last, f.tries, n.event_type = 'error' AND f.cycle > 0 AND f.tries < 3 AND coalesce(n.us - f.last >= {6 * HOUR}, FALSE) AS due FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1))
    SELECT event_id, cycle::BIGINT AS cycle, tries::BIGINT AS retry, tries = 3 AS exhausted FROM f WHERE hit""")
def retry_cycles_spaced(spark, sf_dir):
    e, t = events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type", micros().alias("us")), F.col("event_type")
    return sequences.spaced_retries(e, "user_id", ORDER, "us", t == "click", t == "error", 6 * HOUR).select("event_id", "cycle", "retry", "exhausted")


@query(f"""
    WITH RECURSIVE {_NUMBERED}, s AS (SELECT user_id, 0 AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS last, FALSE AS due FROM n WHERE k = 1),
    f AS (SELECT user_id, k, event_id, last, due FROM s UNION ALL
        SELECT user_id, k, event_id, CASE WHEN ok THEN us ELSE last END, ok
        FROM (SELECT n.user_id, n.k, n.event_id, n.us, f.last, n.event_id % 3 = 0 AND coalesce(n.us - f.last >= {6 * HOUR}, TRUE) AS ok FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1)),
    c AS (SELECT e.*, {CODE_SQL} IN (200, 400, 422) AS done FROM events e JOIN f USING (user_id, event_id) WHERE f.due),
    u AS (SELECT *, coalesce(count(*) FILTER (done) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session FROM c)
    SELECT user_id, session, count(*) AS attempts, min(ts) AS session_start, max(ts) AS session_end, bool_or(done) AS finished FROM u GROUP BY ALL""")
def upload_sessions_due(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type", micros().alias("us"), (F.col("event_id") % 3).alias("queued"))
    return sequences.upload_sessions(sequences.due_uploads(e, "user_id", ORDER, "us", "queued", 6 * HOUR), "user_id", ORDER, "ts", code().isin(200, 400, 422))
