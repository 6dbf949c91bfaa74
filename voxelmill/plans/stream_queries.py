"""Streams over the events table, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmill.plans import fixtures as X
from voxelmill.streaming import streams as S

QUERIES, ORACLE = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _events(s, d):
    return S.file_stream(s, f"{d}/events.parquet").select("event_id", F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), F.expr(X.STATUS).alias("status"))


TK = f"WITH t AS ({X.duck(X.TASKS)})"
_add("t01_t03_t04_ingest", lambda s, d: S.drain(_events(s, d)).groupBy("status").agg(F.count("*").alias("n")), TK + " SELECT status, count(*) AS n FROM t GROUP BY 1")
_add("t07_failure_ledger", lambda s, d: S.drain(S.failure_ledger(_events(s, d), "task_id"), "complete"), TK + " SELECT task_id, count(*) AS failures, count(*) < 2 AS retry FROM t WHERE status = 'failed' GROUP BY 1")
_add("t13_t17_completed_once", lambda s, d: S.drain(S.completed_once(_events(s, d), "event_id", "ts")).select("event_id"), TK + " SELECT event_id FROM t WHERE status = 'completed'")
_add("x_window_counts", lambda s, d: S.drain(S.window_counts(_events(s, d), "ts", "1 day", by=["status"])).select(F.date_format("begin", "yyyy-MM-dd").alias("day"), "status", "n"),
     TK + " SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, status, count(*) AS n FROM t GROUP BY ALL HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM t)")


def _levels(s, d):
    """Sizes of folders as they change: 35 to 47."""
    events = S.file_stream(s, f"{d}/events.parquet")
    return events.select(F.col("user_id").alias("folder"), F.col("ts").cast("timestamp").alias("ts"), F.expr("35.0 + event_id * 7 % 13").alias("gb"))


#: Held is what the last level at or beyond a mark says; a silence is told where the next row, or the end of time so far, is far enough.
_add(
    "t02_t05_flow_control",
    lambda s, d: S.drain(S.flow_control(_levels(s, d), "folder", "ts", "gb", idle_seconds=86400.0)),
    """WITH e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS "at", 35.0 + event_id * 7 % 13 AS level FROM events),
  m AS (SELECT *, CASE WHEN level >= 45 THEN 1 WHEN level <= 40 THEN 0 END AS mark FROM e),
  h AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER w, 0) AS held, lead("at") OVER (PARTITION BY key ORDER BY "at", level) AS next FROM m WINDOW w AS (PARTITION BY key ORDER BY "at", level ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY key ORDER BY "at", level), 0) AS before FROM h)
  SELECT key, "at", level::DOUBLE AS level, CASE WHEN held = 1 AND before = 0 THEN 'pause' WHEN held = 1 THEN 'wait' WHEN before = 1 THEN 'resume' ELSE 'go' END AS signal FROM b
  UNION ALL SELECT key, "at" + 86400000000, NULL, 'idle' FROM b WHERE next - "at" > 86400000000 OR next IS NULL AND "at" + 86400000000 <= (SELECT max("at") FROM e)""",
)


def _logs(s, d):
    events = S.file_stream(s, f"{d}/events.parquet")
    return events.select(F.col("user_id").alias("task"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("line"), F.col("event_type").alias("status"), (F.col("event_type") == "error").alias("forced"))


_add(
    "k13_task_updates",
    lambda s, d: S.drain(S.task_updates(_logs(s, d), "task", "ts", "line", "status", "forced", seconds=43200.0), "batches").select("key", "at", "status", F.array_join("logs", ",").alias("logs")),
    """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS "at", concat(event_type, ' ', event_id) AS line, event_type AS status FROM events),
  l AS (SELECT *, row_number() OVER w AS n, array_to_string(list(line) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS logs FROM e WINDOW w AS (PARTITION BY key ORDER BY "at", line)),
  u AS (SELECT key, "at", n FROM l WHERE status <> 'error'),
  t(key, "at", n) AS (SELECT key, min("at"), min(n) FROM u GROUP BY key
    UNION ALL SELECT t.key, (SELECT min(u."at") FROM u WHERE u.key = t.key AND u.n > t.n AND u."at" >= t."at" + 43200000000), (SELECT min(u.n) FROM u WHERE u.key = t.key AND u.n > t.n AND u."at" >= t."at" + 43200000000) FROM t WHERE t.n IS NOT NULL)
  SELECT l.key, l."at", l.status, l.logs FROM l WHERE status = 'error' OR EXISTS (SELECT 1 FROM t WHERE t.key = l.key AND t.n = l.n)""",
)


def _spaced(key: str, micros: int) -> str:
    """The events of each key that come so long after the last one taken."""
    return f"""WITH RECURSIVE e AS (SELECT {key} AS key, epoch_us(ts) AS us FROM events),
  t(key, us) AS (SELECT key, min(us) FROM e GROUP BY key UNION ALL SELECT t.key, (SELECT min(e.us) FROM e WHERE e.key = t.key AND e.us >= t.us + {micros}) FROM t WHERE t.us IS NOT NULL)
  SELECT key, us AS "at" FROM t WHERE us IS NOT NULL"""


_add("t08_locked_starts_stream", lambda s, d: S.drain(S.locked_starts(_events(s, d), "task_id", "ts", 43200.0)), _spaced("user_id::VARCHAR", 43_200_000_000))
_add("t12_w12_throttled", lambda s, d: S.drain(S.throttled(_events(s, d), "task_id", "ts", 86400.0)), _spaced("user_id", 86_400_000_000))
# a spell is told once no row can lengthen it any more
_add(
    "t09_quiet_sessions_stream",
    lambda s, d: S.drain(S.quiet_sessions(_events(s, d), "task_id", "ts", "1 day")).groupBy("task_id").agg(F.sum("changes").alias("changes")),
    TK
    + """, g AS (SELECT task_id, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 86400000000, true) AS new FROM t WINDOW w AS (PARTITION BY task_id ORDER BY ts)),
  s AS (SELECT *, sum(new::INT) OVER (PARTITION BY task_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS spell FROM g),
  c AS (SELECT task_id, count(*) AS changes FROM s GROUP BY task_id, spell HAVING max(us) + 86400000000 <= (SELECT max(us) FROM g))
  SELECT task_id, sum(changes)::BIGINT AS changes FROM c GROUP BY 1""",
)
