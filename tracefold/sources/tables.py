"""Relational tables seen as event logs.

Every log has the columns ``case_id STRING, activity STRING, event_time TIMESTAMP, arrival_seq BIGINT``.
``arrival_seq`` is unique in the log and is the order in which the events were delivered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_COLUMNS = ["case_id", "activity", "event_time", "arrival_seq"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_log(df: DataFrame, case: Column, activity: Column, event_time: Column, arrival: Column) -> DataFrame:
    return df.select(
        case.cast("string").alias("case_id"),
        activity.cast("string").alias("activity"),
        event_time.cast("timestamp").alias("event_time"),
        arrival.cast("bigint").alias("arrival_seq"),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases, order states as activities; most events arrive late."""
    o = table(spark, sf_dir, "orders")
    return as_log(o, F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderdate"), F.col("o_orderkey"))


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a user as one case, in order."""
    e = table(spark, sf_dir, "events")
    return as_log(e, F.col("user_id"), F.col("event_type"), F.col("ts"), F.col("event_id"))


def user_day_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user on one day as one case, in order."""
    e = table(spark, sf_dir, "events")
    case = F.concat_ws("|", F.col("user_id"), F.to_date("ts"))
    return as_log(e, case, F.col("event_type"), F.col("ts"), F.col("event_id"))


def lineitem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free log: the line items of an order with flag and status as activity (no arrival order exists)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("case_id"),
        F.concat("l_returnflag", "l_linestatus").alias("activity"),
        F.col("l_shipdate").alias("event_time"),
    )
