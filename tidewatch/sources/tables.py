"""Readers for the warehouse tables and the views the analytics run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICKS = 10_000      # money is kept as whole ten-thousandths: exact, and sums in any order agree


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item: customer, invoice, ts, product, value, cancel, country.

    ``value`` is price x (1 - discount) in ten-thousandths (see TICKS).  The order join is a plain
    equi join, so adaptive execution may split an order key that holds very many lines.
    """
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_extendedprice", "l_discount",
                  "l_returnflag").filter(F.col("l_extendedprice") > 0)
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation", "n_nationkey", "n_name")
    value = F.rint(F.col("l_extendedprice") * 100).cast("bigint") * (
        F.lit(100) - F.rint(F.col("l_discount") * 100).cast("bigint"))
    home = customers.join(nations, customers.c_nationkey == nations.n_nationkey)
    placed = orders.join(home, orders.o_custkey == home.c_custkey)
    return lines.join(placed, lines.l_orderkey == placed.o_orderkey).select(
        F.col("o_custkey").alias("customer"), F.col("l_orderkey").alias("invoice"),
        F.col("o_orderdate").alias("ts"), F.col("l_partkey").alias("product"),
        value.alias("value"), (F.col("l_returnflag") == "R").alias("cancel"),
        F.col("n_name").alias("country"))
