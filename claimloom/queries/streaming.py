"""Queries of the streaming operators in their batch form, over ``events``: a user's hundredth is a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.queries import query
from claimloom.streaming import events as W

TYPES = {"view": "step.start", "click": "crawl.progress", "signup": "source.found", "purchase": "step.done", "error": "run.error"}


def as_runs(e):
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in TYPES.items()))
    return e.select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind.alias("type"), F.concat(F.lit("s"), F.col("event_id") % 5).alias("step_id"), "value", F.col("props").alias("message"))


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " END"
_RUNS = f"(SELECT user_id * 10 + event_id % 10 AS run_id, event_id AS seq, ts AS at, {_CASE} AS type, 's' || (event_id % 5) AS step_id, value, props AS message FROM events)"


@query(
    "w1_run_state",
    f"""SELECT run_id, count(*) AS events, count(*) FILTER (type = 'step.done') AS steps_done, arg_max(step_id, seq) FILTER (type LIKE 'step.%') AS last_step, arg_max(value, seq) FILTER (type = 'crawl.progress') AS progress,
 count(*) FILTER (type = 'source.found') AS found, max(seq) FILTER (type = 'step.done') AS finished, bool_or(type = 'run.error') AS failed FROM {_RUNS} r GROUP BY run_id""",
)
def w1(t):
    return W.run_state(as_runs(t("events")))


@query("w1_last_log_lines", f"SELECT run_id, CAST(place AS INTEGER) AS place, message FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS place FROM {_RUNS} r) q WHERE place <= 9")
def w1b(t):
    return W.last_log_lines(as_runs(t("events")))


_STEPS = " UNION ALL ".join(f"SELECT '{p}' AS phase, '{s}' AS step, {i} AS pos" for p, ss in W.PHASES.items() for i, s in enumerate(ss))
_PHASE = "list_extract(['discover', 'crawl', 'extract', 'report'], CAST(event_id % 4 + 1 AS INTEGER))"


@query("w2_expand_phases", f"SELECT event_id, step, CASE WHEN event_type = 'view' THEN 'started' ELSE 'done' END AS state FROM events JOIN ({_STEPS}) m ON m.phase = {_PHASE} AND (event_type <> 'view' OR pos = 0)")
def w2(t):
    phase = F.element_at(F.array(*map(F.lit, W.PHASES)), (F.col("event_id") % 4 + 1).cast("int"))
    e = t("events").select("event_id", phase.alias("phase"), F.when(F.col("event_type") == "view", "start").otherwise("end").alias("edge"))
    return W.expand_phases(e).select("event_id", "step", "state")


def requests(e):
    k = F.from_json("props", "k bigint")["k"]
    return e.select("event_id", "user_id", "ts", F.col("event_type").alias("kind"), k.cast("double").alias("credits"), F.col("value").alias("cost"), k.alias("reserved"), F.when(F.col("event_type") != "error", k + 1).alias("reported"))


CAPS = {"credits": 2000.0, "cost": 700.0}
_REQ = "(SELECT event_id, user_id, ts, event_type AS kind, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, value AS cost FROM events)"


@query(
    "w3_budget_tracker",
    f"""WITH c AS (SELECT *, sum(k) OVER w AS ck, sum(cost) OVER w AS cc FROM {_REQ} r WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), o AS (SELECT user_id, min(event_id) AS first FROM c WHERE ck > 2000 OR cc > 700 GROUP BY user_id)
SELECT c.event_id, first IS NULL OR c.event_id < first AS accepted FROM c LEFT JOIN o ON o.user_id = c.user_id""",
)
def w3(t):
    return W.budget_tracker(requests(t("events")), CAPS, run="user_id", order="event_id").select("event_id", "accepted")


_KINDS = list(TYPES)


@query("w4_request_usage", "SELECT user_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS \"{k}\"" for k in _KINDS) + f", CAST(sum(k) AS BIGINT) AS reserved, CAST(sum(CASE WHEN kind <> 'error' THEN k + 1 ELSE 0 END) AS BIGINT) AS reported FROM {_REQ} r GROUP BY user_id")
def w4(t):
    return W.request_usage(requests(t("events")), run="user_id", kinds=_KINDS)


@query(
    "w5_rate_limit",
    """WITH RECURSIVE w AS (SELECT user_id, min(ts) AS s FROM events GROUP BY user_id UNION ALL SELECT w.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.s + INTERVAL 1 HOUR GROUP BY w.user_id),
x AS (SELECT e.event_id, e.user_id, e.ts, max(w.s) AS s FROM events e JOIN w ON w.user_id = e.user_id AND w.s <= e.ts GROUP BY ALL)
SELECT user_id AS client, event_id, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) <= 3 AS allowed FROM x""",
)
def w5(t):
    return W.rate_limit(t("events").withColumn("client", F.col("user_id")), client="client", at="ts", key="event_id", limit=3)


@query(
    "w6_expire_tokens",
    """WITH i AS (SELECT event_id % 3000 AS token, min(ts) AS issued_at FROM events WHERE event_type = 'view' GROUP BY ALL), u AS (SELECT event_id % 3000 AS token, ts AS used_at, event_id AS use_id FROM events WHERE event_type = 'click'),
f AS (SELECT u.token, arg_min(use_id, {'a': used_at, 'b': use_id}) AS first FROM u JOIN i ON i.token = u.token AND used_at >= issued_at AND used_at < issued_at + INTERVAL 20 DAYS GROUP BY u.token)
SELECT use_id, coalesce(use_id = first, false) AS valid FROM u LEFT JOIN f ON f.token = u.token""",
)
def w6(t):
    e = t("events").withColumn("token", F.col("event_id") % 3000)
    issued = e.where("event_type = 'view'").groupBy("token").agg(F.min("ts").alias("issued_at"))
    return W.expire_tokens(issued, e.where("event_type = 'click'").select("token", F.col("ts").alias("used_at"), F.col("event_id").alias("use_id")), ttl="20 days")


@query("w7_stream_snapshots", "SELECT min(doc_id) AS doc_id, source AS url FROM documents GROUP BY source, md5(text)")
def w7(t):
    c = t("documents").select("doc_id", F.col("source").alias("url"), F.md5("text").alias("content_hash"), F.timestamp_seconds("doc_id").alias("captured_at"))
    return W.stream_snapshots(c).select("doc_id", "url")


@query("w8_weekly_rollup", "SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-05 09:00:00') AS week_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def w8(t):
    return W.weekly_rollup(t("events")).withColumn("value", F.round("value", 4))


@query("w9_latest_webhook_status", "SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def w9(t):
    return W.latest_status(t("events"), run="user_id", status="event_type", at="ts")
