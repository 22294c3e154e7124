"""Monthly panels aggregated from transaction tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.expressions import as_date


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def monthly_panel(
    rows: DataFrame, country: Column, product: Column, time: Column, value: Column
) -> DataFrame:
    """Aggregate any fact rows into the canonical ``panel(Country, Product, Time, Import)``.

    The sum runs on decimals, so the result does not depend on the order of the rows.
    """
    keyed = rows.select(
        country.alias("Country"),
        product.alias("Product"),
        F.trunc(time, "month").alias("Time"),
        value.alias("amount"),
    )
    return keyed.groupBy("Country", "Product", "Time").agg(
        F.sum("amount").cast("double").alias("Import")
    )


def panel_from_tables(
    spark: SparkSession,
    folder: str,
    start: str | date | int | None = None,
    end: str | date | int | None = None,
) -> DataFrame:
    """Shipped value per customer nation, market segment and month, within [start, end).

    The date bounds reach the Parquet scan. Line amounts are summed per customer and month before
    the customer table is joined, so one customer with a large share of all lines arrives at that
    join as one row per month.
    """
    lines = read_table(spark, folder, "lineitem")
    if start is not None:
        lines = lines.where(F.col("l_shipdate") >= F.lit(as_date(start)).cast("timestamp_ntz"))
    if end is not None:
        lines = lines.where(F.col("l_shipdate") < F.lit(as_date(end)).cast("timestamp_ntz"))
    lines = lines.select(
        "l_orderkey",
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
    )
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = read_table(spark, folder, "customer")
    nations = read_table(spark, folder, "nation").select("n_nationkey", "n_name")

    per_customer = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "month")
        .agg(F.sum("price").alias("price"))
    )
    placed = customers.select("c_custkey", "c_nationkey", "c_mktsegment").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return monthly_panel(
        per_customer.join(placed, F.col("o_custkey") == F.col("c_custkey")),
        F.col("n_name"),
        F.col("c_mktsegment"),
        F.col("month"),
        F.col("price"),
    )
