"""Streams over the events table, run to their end, with the SQL of what must have come out by then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.streaming.dedup import first_of_key
from tessera.streaming.funnels import funnels
from tessera.streaming.interval_join import interval_join
from tessera.streaming.tables import ROCKSDB, drain, table_stream
from tessera.streaming.windows import event_windows

DELAY = "10 minutes"
STEPS = ("view", "click", "purchase")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_stream(spark, f"{sf_dir}/events.parquet")


def _sums() -> list:
    return [F.count("*").alias("n_events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(20,2)").alias("total")]


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours by event type, closed by a watermark of ten minutes."""
    return drain(event_windows(_events(spark, sf_dir), "ts", DELAY, _sums(), by=("event_type",), size="1 hour"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hours, beginning at each half."""
    return drain(event_windows(_events(spark, sf_dir), "ts", DELAY, _sums(), size="2 hours", slide="30 minutes"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, of pauses of at most half an hour."""
    return drain(event_windows(_events(spark, sf_dir), "ts", DELAY, _sums(), by=("user_id",), gap="30 minutes"))


def stream_click_to_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within two hours of a click of their user."""
    of = lambda kind: _events(spark, sf_dir).where(F.col("event_type") == kind)
    clicks = of("click").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    bought = of("purchase").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"), "value")
    out = interval_join(clicks, bought, "click_ts", "purchase_ts", ("user_id",), "0 seconds", "2 hours", DELAY, DELAY)
    return drain(out.select("user_id", "click_id", "purchase_id", "value"))


def stream_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of a user, of pauses of at most an hour, and how far each came from view to click to purchase."""
    return drain(funnels(_events(spark, sf_dir), "user_id", "ts", "event_type", STEPS, 3600, DELAY), settings=ROCKSDB)


def stream_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are delivered twice, each taken once."""
    events = _events(spark, sf_dir).select("event_id", "ts", "user_id", "value")
    again = _events(spark, sf_dir).select("event_id", "ts", "user_id", "value")
    out = first_of_key(events.unionByName(again), ("event_id",), "ts", DELAY)
    return drain(out.select("event_id", "user_id", "value"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_sessions, stream_click_to_purchase, stream_funnels, stream_replayed)}

#: The last watermark, in whole milliseconds as Spark keeps it.
_SEEN = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTES FROM events)"
_SUMS = "count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(20,2)) AS total"
_VISITS = """
SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING) AS visit FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) <= INTERVAL {gap} MINUTES THEN 0 ELSE 1 END AS fresh FROM events
)"""

ORACLE_SQL = {
    "stream_tumbling": f"""
SELECT event_type, start AS window_start, start + INTERVAL 1 HOUR AS window_end, {_SUMS}
FROM (SELECT event_type, value, time_bucket(INTERVAL 1 HOUR, ts) AS start FROM events) GROUP BY event_type, start HAVING start + INTERVAL 1 HOUR <= {_SEEN}""",
    "stream_sliding": f"""
SELECT start AS window_start, start + INTERVAL 2 HOURS AS window_end, {_SUMS}
FROM (SELECT value, time_bucket(INTERVAL 30 MINUTES, ts) - k * INTERVAL 30 MINUTES AS start FROM events, range(4) r(k))
GROUP BY start HAVING start + INTERVAL 2 HOURS <= {_SEEN}""",
    "stream_sessions": f"""
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTES AS window_end, {_SUMS}
FROM ({_VISITS.format(gap=30)}) GROUP BY user_id, visit HAVING max(ts) + INTERVAL 30 MINUTES <= {_SEEN}""",
    "stream_click_to_purchase": """
SELECT c.user_id, c.event_id AS click_id, p.event_id AS purchase_id, p.value FROM events c JOIN events p
ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 2 HOURS""",
    "stream_replayed": "SELECT event_id, user_id, value FROM events",
    "stream_funnels": f"""
WITH v AS ({_VISITS.format(gap=60)}), one AS (
  SELECT user_id, visit, min(ts) AS visit_start, max(ts) AS visit_end, count(*) AS n_events, min(ts) FILTER (WHERE event_type = 'view') AS t1 FROM v GROUP BY user_id, visit
), two AS (
  SELECT one.*, (SELECT min(ts) FROM v WHERE v.user_id = one.user_id AND v.visit = one.visit AND event_type = 'click' AND ts > t1) AS t2 FROM one
), three AS (
  SELECT two.*, (SELECT min(ts) FROM v WHERE v.user_id = two.user_id AND v.visit = two.visit AND event_type = 'purchase' AND ts > t2) AS t3 FROM two
)
SELECT user_id, visit_start, visit_end, n_events, CAST((t1 IS NOT NULL)::INT + (t2 IS NOT NULL)::INT + (t3 IS NOT NULL)::INT AS INTEGER) AS n_steps
FROM three WHERE visit_end + INTERVAL 1 HOUR < {_SEEN}""",
}
