"""Queries of the as-of and range joins and of span summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.asof_join import asof_join
from tessera.operators.range_join import range_join
from tessera.operators.span_summary import span_summary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", "user_id", "ts", "value")


def asof_last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's last click until then."""
    clicks = _events(spark, sf_dir, "click").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    out = asof_join(_events(spark, sf_dir, "purchase"), clicks, "ts", "ts", by=("user_id",))
    return out.select("event_id", "user_id", "ts", "click_id", "ts_right", "click_value")


def asof_next_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signup that an error of anyone follows within an hour, with the first such error: one key for all rows."""
    out = asof_join(_events(spark, sf_dir, "signup"), _events(spark, sf_dir, "error"), "ts", "ts", direction="forward", allow_exact=False, tolerance=F.expr("INTERVAL 1 HOUR"), how="inner")
    return out.select("event_id", "ts", F.col("event_id_right").alias("error_id"), F.col("ts_right").alias("error_ts"), F.col("user_id_right").alias("error_user"))


def asof_nearest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the view of its user that is nearest in time, before or after."""
    out = asof_join(_events(spark, sf_dir, "purchase"), _events(spark, sf_dir, "view"), "ts", "ts", by=("user_id",), direction="nearest")
    return out.select("event_id", "user_id", F.col("event_id_right").alias("view_id"), F.col("ts_right").alias("view_ts"))


def asof_prior_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its customer's last order of an earlier day, of equal days the largest key, if at most 90 days back."""
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(14,2)").alias("price"))
    out = asof_join(orders, orders, "o_orderdate", "o_orderdate", by=("o_custkey",), allow_exact=False, tolerance=F.expr("INTERVAL 90 DAYS"), tie_break=("o_orderkey",))
    return out.select("o_orderkey", "o_custkey", F.col("o_orderkey_right").alias("prior_key"), (F.col("price") - F.col("price_right")).cast("decimal(16,2)").alias("price_change"))


def range_open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order, how many other orders of its customer are open at some time from its date to its last shipment."""
    shipped = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last_ship"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(shipped, "o_orderkey").select("o_orderkey", "o_custkey", "o_orderdate", "last_ship")
    out = range_join(orders, orders, ("o_orderdate", "last_ship"), ("o_orderdate", "last_ship"), by=("o_custkey",), how="left", left_key=("o_orderkey",))
    other = F.col("o_orderkey_right") != F.col("o_orderkey")
    return out.groupBy("o_orderkey", "o_custkey").agg(F.count_if(other).alias("n_open"), F.min(F.when(other, F.col("o_orderkey_right"))).alias("first_open"))


def range_price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier, the parts whose retail price is within 25 of its balance: no column is equal on both sides."""
    bands = _table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - 25).alias("low"), (F.col("s_acctbal") + 25).alias("high"))
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    out = range_join(bands, parts, ("low", "high"), ("p_retailprice", "p_retailprice"))
    return out.groupBy("s_suppkey").agg(F.count("*").alias("n_parts"), F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"))


def range_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error, the events from ten minutes before it until ten minutes after it, that end excluded."""
    errors = _events(spark, sf_dir, "error").select("event_id", (F.col("ts") - F.expr("INTERVAL 10 MINUTES")).alias("since"))
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("other_id"), "user_id", "ts")
    out = span_summary(errors, events, "event_id", "since", 20 * 60 * 1_000_000, "ts", "user_id", "other_id")
    return out.select("event_id", F.col("n").alias("n_events"), F.col("owners").alias("n_users"), F.col("least").alias("first_id"), F.col("largest").alias("last_id"))


QUERIES = {f.__name__: f for f in (asof_last_click, asof_next_error, asof_nearest_view, asof_prior_order, range_open_orders, range_price_bands, range_incidents)}

_KIND = "(SELECT event_id, user_id, ts, value FROM events WHERE event_type = '{}')"

ORACLE_SQL = {
    "asof_last_click": f"""
SELECT p.event_id, p.user_id, p.ts, c.event_id AS click_id, c.ts AS ts_right, c.value AS click_value
FROM {_KIND.format("purchase")} p ASOF LEFT JOIN {_KIND.format("click")} c ON p.user_id = c.user_id AND p.ts >= c.ts""",
    "asof_next_error": f"""
SELECT s.event_id, s.ts, e.event_id AS error_id, e.ts AS error_ts, e.user_id AS error_user
FROM {_KIND.format("signup")} s ASOF JOIN {_KIND.format("error")} e ON s.ts < e.ts WHERE e.ts <= s.ts + INTERVAL 1 HOUR""",
    "asof_nearest_view": f"""
WITH p AS {_KIND.format("purchase")}, v AS {_KIND.format("view")}, back AS (
  SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id, v.ts AS view_ts FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts
), next AS (
  SELECT p.event_id, v.event_id AS view_id, v.ts AS view_ts FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.ts
)
SELECT b.event_id, b.user_id, CASE WHEN later THEN n.view_id ELSE b.view_id END AS view_id, CASE WHEN later THEN n.view_ts ELSE b.view_ts END AS view_ts
FROM (SELECT *, b.view_ts IS NULL OR coalesce(epoch_us(n.view_ts) - epoch_us(b.ts) < epoch_us(b.ts) - epoch_us(b.view_ts), false) AS later FROM back b JOIN next n USING (event_id)) x
JOIN back b ON b.event_id = x.event_id JOIN next n ON n.event_id = x.event_id""",
    "asof_prior_order": """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, CAST(o_totalprice AS DECIMAL(14,2)) AS price FROM orders),
last AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1)
SELECT a.o_orderkey, a.o_custkey, CASE WHEN b.o_orderdate + INTERVAL 90 DAYS >= a.o_orderdate THEN b.o_orderkey END AS prior_key,
  CAST(CASE WHEN b.o_orderdate + INTERVAL 90 DAYS >= a.o_orderdate THEN a.price - b.price END AS DECIMAL(16,2)) AS price_change
FROM o a ASOF LEFT JOIN last b ON a.o_custkey = b.o_custkey AND a.o_orderdate > b.o_orderdate""",
    "range_open_orders": """
WITH o AS (
  SELECT o_orderkey, o_custkey, o_orderdate, max(l_shipdate) AS last_ship FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
)
SELECT a.o_orderkey, a.o_custkey, count(b.o_orderkey) AS n_open, min(b.o_orderkey) AS first_open
FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND a.o_orderdate <= b.last_ship AND b.o_orderdate <= a.last_ship
  AND a.o_orderdate <= a.last_ship AND b.o_orderdate <= b.last_ship
GROUP BY a.o_orderkey, a.o_custkey""",
    "range_price_bands": """
SELECT s_suppkey, count(*) AS n_parts, min(p_retailprice) AS least, max(p_retailprice) AS most
FROM supplier JOIN part ON p_retailprice BETWEEN s_acctbal - 25 AND s_acctbal + 25 GROUP BY s_suppkey""",
    "range_incidents": f"""
SELECT r.event_id, count(*) AS n_events, count(DISTINCT e.user_id) AS n_users, min(e.event_id) AS first_id, max(e.event_id) AS last_id
FROM {_KIND.format("error")} r JOIN events e ON e.ts >= r.ts - INTERVAL 10 MINUTES AND e.ts < r.ts + INTERVAL 10 MINUTES GROUP BY r.event_id""",
}
