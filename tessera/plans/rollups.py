"""Queries of stored sketches and of recursive reach, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.reach import reach
from tessera.operators.sketches import DISTINCT_ERROR, RANK_ERROR, estimates, roll_up, sketch
from tessera.streaming.tables import shared_folder

SPECS = {"parts": ("distinct", "l_partkey"), "price": ("quantiles", "l_extendedprice")}


def sketch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches stored by day of shipment, rolled up to years, held against exact values: true where they are within their bounds (four standard errors; twice the rank error)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_partkey", "l_extendedprice")
    days = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    sketch(lines.withColumn("day", F.to_date("l_shipdate")), ("day",), SPECS).write.parquet(days)
    years = estimates(roll_up(spark.read.parquet(days).withColumn("ship_year", F.year("day")), ("ship_year",), SPECS), SPECS, ranks=(0.5,))
    years = years.select("ship_year", "n", F.col("parts"), F.get("price", F.lit(0)).alias("median"))
    exact = lines.withColumn("ship_year", F.year("l_shipdate")).join(years, "ship_year")
    exact = exact.groupBy("ship_year", "n", "parts", "median").agg(F.count_distinct("l_partkey").alias("true_parts"), F.avg((F.col("l_extendedprice") <= F.col("median")).cast("int")).alias("rank"))
    near = F.abs(F.col("parts") - F.col("true_parts")) <= 4 * DISTINCT_ERROR * F.col("true_parts")
    return exact.select("ship_year", F.col("n").alias("n_lines"), "true_parts", near.alias("parts_within"), (F.abs(F.col("rank") - 0.5) <= 2 * RANK_ERROR).alias("median_within"))


def trade_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest steps between nations, where an edge goes from a supplier's nation to the two nations whose customers take the most from it."""
    of = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sold = of("lineitem").join(of("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("seller")), "l_suppkey")
    sold = sold.join(of("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    sold = sold.join(of("customer").select("c_custkey", F.col("c_nationkey").alias("buyer")), "c_custkey").where("seller <> buyer")
    sums = sold.groupBy("seller", "buyer").agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("quantity"))
    place = F.row_number().over(Window.partitionBy("seller").orderBy(F.desc("quantity"), "buyer"))
    edges = sums.withColumn("place", place).where("place <= 2")
    return reach(edges, "seller", "buyer", MAX_STEPS).select(F.col("start").alias("seller"), F.col("node").alias("buyer"), "steps")


MAX_STEPS = 8
QUERIES = {f.__name__: f for f in (sketch_audit, trade_reach)}
ORACLE_SQL = {
    "trade_reach": f"""
WITH RECURSIVE sums AS (
  SELECT s_nationkey AS seller, c_nationkey AS buyer, sum(CAST(l_quantity AS DECIMAL(12,2))) AS quantity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE s_nationkey <> c_nationkey GROUP BY 1, 2
), edges AS (
  SELECT seller, buyer FROM sums QUALIFY row_number() OVER (PARTITION BY seller ORDER BY quantity DESC, buyer) <= 2
), walks(seller, buyer, steps) AS (
  SELECT seller, buyer, 1 FROM edges UNION SELECT w.seller, e.buyer, w.steps + 1 FROM walks w JOIN edges e ON e.seller = w.buyer WHERE w.steps < {MAX_STEPS}
)
SELECT seller, buyer, CAST(min(steps) AS INTEGER) AS steps FROM walks GROUP BY seller, buyer""",
    "sketch_audit": """
SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, count(*) AS n_lines, count(DISTINCT l_partkey) AS true_parts, true AS parts_within, true AS median_within
FROM lineitem GROUP BY 1""",
}
