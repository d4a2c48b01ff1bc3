"""The star-schema tables in the roles of a survey: line items as records, orders as parents, suppliers as clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.values import quarter_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the context of their order and part. Only the columns a query uses reach the scans."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey).withColumn("period", quarter_index(F.col("l_shipdate")))


RECORDS = """records AS (
  SELECT l.*, o.o_custkey, o.o_orderstatus, o.o_orderpriority, o.o_orderdate, p.p_brand, p.p_type, p.p_size,
         CAST(year(l_shipdate) * 4 + quarter(l_shipdate) AS INTEGER) AS period
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as review cases: tails of the total within priority, a coding tail by customer, rule flags."""
    from plumbline.functions.tails import places

    o = table(spark, sf_dir, "orders")
    p = places(o.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey", "o_totalprice"), ["o_orderpriority"], "o_totalprice")
    return p.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("state"), F.col("o_orderstatus").alias("sector"), (F.col("o_custkey") % 50).alias("cluster"),
        F.col("two_sided").alias("p"), F.when(F.col("o_orderkey") % 3 == 0, (F.pmod(F.col("o_orderkey") * 7919, F.lit(10007)) + 1) / 10008.0).alias("coding_p"),
        (F.pmod(F.col("o_orderkey") * 31, F.lit(997)) == 5).alias("hard"), (F.pmod(F.col("o_orderkey") * 17, F.lit(499)) == 3).alias("soft"), F.col("o_totalprice").alias("impact"))


CASES = """ranked AS (
  SELECT *, rank() OVER w - 1 AS below, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS le, count(*) OVER (PARTITION BY o_orderpriority) AS n
  FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice)),
cases AS (
  SELECT o_orderkey AS case_id, o_orderpriority AS state, o_orderstatus AS sector, o_custkey % 50 AS cluster,
         least(1.0::DOUBLE, 2 * least((n - below)::DOUBLE / n, le::DOUBLE / n)) AS p,
         CASE WHEN o_orderkey % 3 = 0 THEN ((o_orderkey * 7919) % 10007 + 1) / 10008.0::DOUBLE END AS coding_p,
         (o_orderkey * 31) % 997 = 5 AS hard, (o_orderkey * 17) % 499 = 3 AS soft, o_totalprice AS impact
  FROM ranked)"""
