"""Batch forms of the stateful stream functions and of the outbox over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.plans.market import query, table
from siltstone.streaming import outbox, state


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) AS t, event_id AS id FROM events),
    kept AS (
        SELECT user_id, event_type, min({'t': t, 'id': id}) AS k FROM e GROUP BY ALL
        UNION ALL
        SELECT e.user_id, e.event_type, min({'t': e.t, 'id': e.id}) FROM kept JOIN e ON e.user_id = kept.user_id AND e.event_type = kept.event_type AND e.t > kept.k.t + 7200000000 GROUP BY ALL),
    n AS (SELECT user_id, event_type, k.t AS t, k.id AS id, lead(k.t) OVER (PARTITION BY user_id, event_type ORDER BY k.t) AS following FROM kept)
    SELECT n.user_id, n.event_type, make_timestamp(n.t) AS kept_ts, n.id AS kept_id, count(e.id) - 1 AS n_dropped
    FROM n JOIN e ON e.user_id = n.user_id AND e.event_type = n.event_type AND (e.t > n.t OR e.t = n.t AND e.id >= n.id) AND (n.following IS NULL OR e.t < n.following) GROUP BY ALL""")
def counted_duplicates(spark, sf_dir):
    return state.counted_duplicates(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 7200)


#: A signup needs the first purchase of its user and the days after it.
@query("""
    WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE event_type WHEN 'signup' THEN 'need' ELSE 'bar' END AS k, value AS v FROM events WHERE event_type IN ('signup', 'purchase')),
    o AS (SELECT user_id, min(t) FILTER (k = 'need') AS need, min({'t': t, 'v': v}) FILTER (k = 'bar') AS bar FROM e GROUP BY 1 HAVING need IS NOT NULL),
    l AS (SELECT *, (need // 3600000000 + 24) * 3600000000 AS lim, (SELECT max(t) FROM e) AS last FROM o)
    SELECT user_id, 'found' AS outcome, make_timestamp(need) AS needed_at, make_timestamp(bar.t) AS found_at, bar.v AS value,
           CAST(least(24, greatest(0, (bar.t - 1) // 3600000000 - need // 3600000000)) AS INT) AS attempts FROM l WHERE bar IS NOT NULL
    UNION ALL SELECT user_id, 'gave_up', make_timestamp(need), NULL, NULL, 24 FROM l WHERE lim < last AND (bar IS NULL OR lim < bar.t)""")
def late_actuals(spark, sf_dir):
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase"))
    kinds = events.withColumn("kind", F.when(F.col("event_type") == "signup", "need").otherwise("bar"))
    return state.late_actuals(kinds, ["user_id"], "ts", "kind", "value")


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS head FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT user_id, ts, sum(head) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
    SELECT user_id, min(ts) AS first_ts, max(ts) + INTERVAL 1800 SECOND AS fire_ts, count(*) AS n_requests FROM b GROUP BY user_id, burst""")
def debounced(spark, sf_dir):
    return state.debounced(table(spark, sf_dir, "events"), "ts", ["user_id"], 1800)


_NOW = "2024-01-20 12:00:00"
#: Rows of the outbox: events; attempts at every fifth of them, three for those of errors, which fail.
_STATE_SQL = f"""
    r AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, props AS payload, ts AS created_at FROM events),
    a AS (SELECT CAST(event_id AS VARCHAR) AS id, ts + INTERVAL 1 DAY * n AS tried_at, event_type <> 'error' AND n = 1 AS ok FROM events, (SELECT unnest([1, 2, 3]) AS n) WHERE event_id % 5 = 0 AND (n = 1 OR event_type = 'error')),
    t AS (SELECT id, min(tried_at) FILTER (ok) AS completed_at, count(*) AS attempts, max(tried_at) AS last_at FROM a GROUP BY id),
    s AS (SELECT r.*, CAST(coalesce(attempts, 0) AS INT) AS attempts, completed_at, CASE WHEN completed_at IS NULL AND attempts IS NOT NULL THEN 'refused' END AS last_error,
        CASE WHEN completed_at IS NULL THEN coalesce(last_at + to_seconds(least(30 * pow(2, attempts - 1), 3600)), created_at) END AS next_retry_at FROM r LEFT JOIN t USING (id))"""


def _states(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.col("props").alias("payload"), F.col("ts").alias("created_at"))
    tries = events.where(F.col("event_id") % 5 == 0).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where((F.col("n") == 1) | (F.col("event_type") == "error"))
    ok = (F.col("event_type") != "error") & (F.col("n") == 1)
    later = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("n").cast("long") * 86_400_000_000)
    attempts = tries.select(F.col("event_id").cast("string").alias("id"), later.alias("tried_at"), ok.alias("ok"), F.when(~ok, "refused").alias("error"))
    return outbox.state(rows, attempts)


@query(f"WITH {_STATE_SQL} SELECT * FROM s")
def outbox_state(spark, sf_dir):
    return _states(spark, sf_dir)


@query(f"WITH {_STATE_SQL} SELECT id, kind, created_at, attempts FROM s WHERE completed_at IS NULL AND next_retry_at <= TIMESTAMP '{_NOW}' ORDER BY created_at, id LIMIT 100")
def outbox_due(spark, sf_dir):
    return outbox.due(_states(spark, sf_dir), F.lit(_NOW).cast("timestamp")).select("id", "kind", "created_at", "attempts")


@query(f"""
    WITH {_STATE_SQL}, d AS (SELECT id, kind FROM s WHERE completed_at IS NULL AND next_retry_at <= TIMESTAMP '{_NOW}')
    SELECT id, s.kind, payload, created_at, CAST(attempts + CASE WHEN d.id IS NULL THEN 0 ELSE 1 END AS INT) AS attempts,
           CASE WHEN d.kind <> 'error' THEN TIMESTAMP '{_NOW}' ELSE completed_at END AS completed_at, CASE WHEN d.kind <> 'error' THEN NULL WHEN d.id IS NOT NULL THEN 'unknown kind' ELSE last_error END AS last_error,
           CASE WHEN d.kind <> 'error' THEN NULL WHEN d.id IS NOT NULL THEN TIMESTAMP '{_NOW}' + to_seconds(least(30 * pow(2, attempts), 3600)) ELSE next_retry_at END AS next_retry_at
    FROM s LEFT JOIN d USING (id)""")
def outbox_after_attempts(spark, sf_dir):
    """All due rows are tried: those of errors fail."""
    states, now = _states(spark, sf_dir), F.lit(_NOW).cast("timestamp")
    tried = states.where(F.col("completed_at").isNull() & (F.col("next_retry_at") <= now))
    ok = F.col("kind") != "error"
    return outbox.after_attempts(states, tried.select("id", ok.alias("ok"), F.when(~ok, "unknown kind").alias("error")), now)
