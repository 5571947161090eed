"""The ledger's tables, derived from the order tables: orders are contracts, lines are their payment plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2000-06-01"
TYPES = {"1": "purchase", "2": "sale", "3": "service", "4": "lease", "5": "other"}
STATES = {"F": "archived", "O": "seal", "P": "approval"}
MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coded(col, codes: dict[str, str]):
    out = F
    for k, v in codes.items():
        out = out.when(col == k, F.lit(v))
    return out


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    signed = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("C-"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("code"),
        coded(F.left("o_orderpriority", F.lit(1)), TYPES).alias("type"),
        coded(F.col("o_orderstatus"), STATES).alias("state"),
        F.col("o_custkey").alias("partner_a"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        signed.alias("date_signed"),
        F.date_add(signed, 365).alias("date_end"),
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = (
        F.when(F.col("l_returnflag") == "A", "paid")
        .when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "F", "cancelled").otherwise("partial"))
        .otherwise(F.when(F.col("l_linestatus") == "F", "confirmed").otherwise("draft"))
    )
    planned = F.col("l_extendedprice").cast(MONEY)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("partner_b"),
        planned.alias("planned"), F.col("l_shipdate").cast("date").alias("planned_date"), state.alias("state"),
        F.when(state == "paid", planned).alias("actual"),
    )


#: The same tables for the SQL oracle.
SQL = """
contracts AS (
  SELECT o_orderkey AS id, 'C-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS code,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'purchase' WHEN '2' THEN 'sale' WHEN '3' THEN 'service' WHEN '4' THEN 'lease' WHEN '5' THEN 'other' END AS type,
    CASE o_orderstatus WHEN 'F' THEN 'archived' WHEN 'O' THEN 'seal' WHEN 'P' THEN 'approval' END AS state,
    o_custkey AS partner_a, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS date_signed, CAST(o_orderdate AS DATE) + 365 AS date_end
  FROM orders
), plans AS (
  SELECT l_orderkey AS contract_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS partner_b, CAST(l_extendedprice AS DECIMAL(18,2)) AS planned, CAST(l_shipdate AS DATE) AS planned_date,
    CASE WHEN l_returnflag = 'A' THEN 'paid' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'cancelled' WHEN l_returnflag = 'R' THEN 'partial' WHEN l_linestatus = 'F' THEN 'confirmed' ELSE 'draft' END AS state,
    CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS actual
  FROM lineitem
)
"""
