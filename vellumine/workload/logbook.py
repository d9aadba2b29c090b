"""Event-log queries; batch twins of the streaming rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.operators import logbook as L
from vellumine.operators.catalog import keep_days, keep_recent
from vellumine.streaming import ttl as T
from vellumine.workload.registry import query, rounded, table


def events(spark, sf):
    return table(spark, sf, "events")


_RANGE = dict(equals={"event_type": "purchase"}, start="2024-01-05", end="2024-01-20")
_WHERE = "event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'"


@query("log_page", f"SELECT event_id, ts, user_id, value FROM events WHERE {_WHERE} ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 20")
def _page(spark, sf):
    return L.log_page(events(spark, sf), L.log_filter(**_RANGE), 20, 50).select("event_id", "ts", "user_id", "value")


@query("log_count", f"SELECT count(*) AS matching FROM events WHERE {_WHERE}")
def _count(spark, sf):
    return L.log_count(events(spark, sf), L.log_filter(**_RANGE))


@query("log_export", f"SELECT event_id, event_type, value, props FROM events WHERE {_WHERE}")
def _export(spark, sf):
    e = events(spark, sf).withColumn("props", F.from_json("props", "k bigint"))
    out = L.export_rows(e, L.log_filter(**_RANGE)).select("event_id", "event_type", "value", "props")
    return out.withColumn("props", F.replace("props", F.lit(":"), F.lit(": ")))


@query("keep_recent", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 1000")
def _recent(spark, sf):
    return keep_recent(events(spark, sf), 1000, "ts", "event_id").select("event_id")


@query("keep_days", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _days(spark, sf):
    return keep_days(events(spark, sf), 7, "ts").select("event_id")


@query(
    "state_transitions",
    """SELECT event_id, user_id, previous_state, event_type AS current_state FROM (
         SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_state FROM events) WHERE previous_state IS NULL OR previous_state <> event_type""",
)
def _transitions(spark, sf):
    t = L.state_transitions(events(spark, sf))
    return t.select("event_id", "user_id", F.col("prev_event_type").alias("previous_state"), F.col("event_type").alias("current_state"))


_LIMITS = {"error": 10.0, "click": 30.0, "view": 1000.0}


@query("latest_metrics", "SELECT event_type AS metric, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY 1")
def _latest(spark, sf):
    return L.latest_metrics(events(spark, sf).withColumnRenamed("event_type", "metric"))


@query(
    "health_status",
    """WITH l AS (SELECT event_type AS m, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1),
       o AS (SELECT m FROM l JOIN (VALUES ('error', 10.0), ('click', 30.0), ('view', 1000.0)) t(n, b) ON m = n AND v > b)
       SELECT CASE WHEN count(*) FILTER (WHERE m = 'view') > 0 THEN 'critical' WHEN count(*) > 0 THEN 'degraded' ELSE 'healthy' END AS status,
         coalesce(string_agg(m, ',' ORDER BY m), '') AS issues FROM o""",
)
def _health(spark, sf):
    latest = L.latest_metrics(events(spark, sf).withColumnRenamed("event_type", "metric"))
    return L.health_status(latest, _LIMITS, ("view",)).withColumn("issues", F.array_join("issues", ","))


@query("metric_window", "SELECT event_id, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 600 MINUTE")
def _window(spark, sf):
    return L.recent_samples(events(spark, sf), 600).select("event_id", "value")


@query("threshold_alerts", "SELECT event_id, event_type, value FROM events JOIN (VALUES ('error', 10.0), ('click', 30.0), ('view', 1000.0)) t(n, b) ON event_type = n AND value > b")
def _alerts(spark, sf):
    return L.threshold_alerts(events(spark, sf), _LIMITS, "event_type").select("event_id", "event_type", "value")


@query(
    "request_keys",
    """SELECT conv_id, turn, 'retrieval:' || substr(sha256('{"query":"' || lower(trim(t, ' ')) || '"}'), 1, 16) AS request_key
       FROM (SELECT conv_id, turn, regexp_replace(text, '[\\n"\\\\/]', ' ', 'g') AS t FROM conversations)""",
)
def _keys(spark, sf):
    # Characters that JSON writers escape differently are spaced out, so the digest is comparable.
    t = F.regexp_replace("text", "[\\n\"\\\\/]", " ")
    return table(spark, sf, "conversations").select("conv_id", "turn", L.request_key(t).alias("request_key"))


@query(
    "reuse_statistics",
    """WITH r AS (SELECT user_id % 50 AS k, ts, event_id, value, lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS p FROM events), h AS (SELECT *, coalesce(ts - p < INTERVAL 30 MINUTE, false) AS hit FROM r)
       SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate,
         round(sum(CASE WHEN hit THEN value ELSE 0 END), 2) AS tokens_saved FROM h""",
)
def _reuse(spark, sf):
    r = L.reuse_statistics(events(spark, sf).withColumn("k", F.col("user_id") % 50), "k", 1800, tokens="value")
    return r.withColumn("hit_rate", rounded("hit_rate", 6)).withColumn("tokens_saved", rounded("tokens_saved", 2))


@query(
    "store_events",
    """WITH r AS (SELECT user_id % 50 AS key, ts, event_id, lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS p FROM events)
       SELECT key, ts AS at, event_id AS id, CASE WHEN ts - p < INTERVAL 30 MINUTE THEN 'hit' ELSE 'miss' END AS event FROM r
       UNION ALL SELECT key, p + INTERVAL 30 MINUTE, NULL, 'expired' FROM r WHERE ts - p >= INTERVAL 30 MINUTE""",
)
def _store(spark, sf):
    return T.batch_events(events(spark, sf).withColumn("k", F.col("user_id") % 50), "k", 1800)


@query("expiry_counts", "SELECT count(*) FILTER (WHERE ts + INTERVAL 7200 SECOND >= TIMESTAMP '2024-01-15') AS active, count(*) FILTER (WHERE ts + INTERVAL 7200 SECOND < TIMESTAMP '2024-01-15') AS expired FROM events")
def _expiry(spark, sf):
    return L.expiry_counts(events(spark, sf), "ts", 7200, F.lit("2024-01-15").cast("timestamp_ntz"))


@query(
    "rate_limit",
    "SELECT event_id, calls, calls > 2 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7200 SECOND PRECEDING AND CURRENT ROW) AS calls FROM events)",
)
def _rate(spark, sf):
    return L.rate_limit(events(spark, sf), 7200, 2).select("event_id", "calls", "limited")


@query(
    "lockouts",
    """SELECT event_id, user_id FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS c
       FROM events WHERE event_type = 'error') WHERE c >= 3""",
)
def _lockouts(spark, sf):
    return L.lockouts(events(spark, sf), F.col("event_type") == "error", 3, 86400).select("event_id", "user_id")


@query("tumbling_buckets", "SELECT user_id, time_bucket(INTERVAL 3600 SECOND, ts) AS bucket, count(*) AS calls, greatest(count(*) - 1, 0) AS rejected FROM events GROUP BY ALL")
def _tumbling(spark, sf):
    return L.tumbling_buckets(events(spark, sf), 3600, 1)


@query(
    "token_buckets",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
       b AS (SELECT user_id, event_id, ts, i, ts AS start, 1 AS used FROM e WHERE i = 1
         UNION ALL SELECT e.user_id, e.event_id, e.ts, e.i, CASE WHEN e.ts - b.start >= INTERVAL 21600 SECOND THEN e.ts ELSE b.start END,
           CASE WHEN e.ts - b.start >= INTERVAL 21600 SECOND THEN 1 ELSE b.used + 1 END FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1)
       SELECT user_id, event_id, start AS bucket_start, used <= 2 AS allowed FROM b""",
)
def _token_buckets(spark, sf):
    return L.token_buckets(events(spark, sf), 21600, 2)


@query(
    "sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
       s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
       SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 HOUR AS end, count(*) AS events FROM s GROUP BY user_id, s""",
)
def _sessions(spark, sf):
    return L.sessions(events(spark, sf), 36000)


@query(
    "sliding_metrics",
    """WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS window_start FROM events)
       SELECT event_type, window_start, round(avg(value), 5) AS mean, max(value) AS max, count(*) AS samples FROM w GROUP BY ALL""",
)
def _sliding(spark, sf):
    return L.sliding_metrics(events(spark, sf), "24 hours", "12 hours").withColumn("mean", rounded("mean", 5))
