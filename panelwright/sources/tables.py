"""Panels derived from the warehouse tables.

Each builder aggregates the raw table straight to one row per (subject, t), so
a subject that owns a third of the raw rows is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_index(ts) -> F.Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ((F.year(ts) - 1995) * 12 + F.month(ts) - 1).cast("int")


def supplier_month(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """(subject, t, s1, s2, s3, a): the supplier-month panel.

    ``until`` (a date) leaves out rows from that day on, such as those of a month
    that has only begun; the default keeps every row.
    """
    returned = F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    rows = table(spark, sf_dir, "lineitem")
    if until is not None:
        rows = rows.filter(F.col("l_shipdate") < F.lit(until).cast("timestamp_ntz"))
    return (
        rows
        .groupBy(F.col("l_suppkey").alias("subject"), month_index("l_shipdate").alias("t"))
        .agg(
            F.sum("l_quantity").alias("s1"),
            F.avg("l_extendedprice").alias("s2"),
            F.avg("l_discount").alias("s3"),
            F.when(3 * returned > F.count(F.lit(1)), 1).otherwise(0).alias("a"),
        )
    )


def horizon(spark: SparkSession, sf_dir: str) -> int:
    """Number of time points of the supplier-month panel: its last month plus one."""
    last = table(spark, sf_dir, "lineitem").agg(month_index(F.max("l_shipdate")).alias("t")).first()["t"]
    return 0 if last is None else last + 1


def supplier_month_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, t, s1, a): the same panel with the first state only."""
    return supplier_month(spark, sf_dir).select("subject", "t", "s1", "a")


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, t, s1, s2, a): events per user and day; a = purchase seen."""
    bought = F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0))
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("user_id").alias("subject"),
            F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).alias("t"),
        )
        .agg(
            F.count(F.lit(1)).cast("double").alias("s1"),
            F.avg("value").alias("s2"),
            F.when(bought > 0, 1).otherwise(0).alias("a"),
        )
    )


def nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, t, s1): orders per nation and month."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy(F.col("c_nationkey").cast("bigint").alias("subject"),
                 month_index("o_orderdate").alias("t"))
        .agg(F.count(F.lit(1)).cast("double").alias("s1"))
    )


def region_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, cluster): a supplier's region is its cluster label."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("subject"), F.col("n_regionkey").alias("cluster")
    )
