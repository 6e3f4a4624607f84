"""Core queries: the tables' own relational workload, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHIPPED_BY = "2001-09-02 00:00:00"


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by return flag and line status; sums in decimals, so partitioning cannot change a digit."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_shipdate") <= F.lit(SHIPPED_BY).cast("timestamp_ntz"))
    price, discount = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("decimal(18,2)").alias("sum_qty"),
        F.sum(price * (1 - discount)).cast("decimal(20,4)").alias("sum_disc_price"),
    )


QUERIES = {"pricing_summary": pricing_summary}
ORACLE_SQL = {
    "pricing_summary": f"""
SELECT l_returnflag, l_linestatus, count(*) AS n_lines,
  CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS sum_qty,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(20,4)) AS sum_disc_price
FROM lineitem WHERE l_shipdate <= TIMESTAMP '{SHIPPED_BY}' GROUP BY l_returnflag, l_linestatus""",
}
