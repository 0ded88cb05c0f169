"""Event logs as CSV files, one per swap setting, and as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.labels import last_segment
from tracefold.operators.hotkeys import position
from tracefold.sources.messages import parse_time

SCHEMA = "_index int, `case:concept:name` string, `concept:name` string, `time:timestamp` string"
BASE_SETTING = "00"


def read_csv_logs(spark: SparkSession, folder: str, dataset: str, limit: int | None = None) -> DataFrame:
    """All settings that are there: ``<dataset>.csv`` is setting 00, ``<setting>.csv`` a swapped log.

    The index column keeps the order before the swaps, so delivery order is the order of the lines.
    """
    raw = spark.read.schema(SCHEMA).option("header", "true").csv(f"{folder}/*.csv")
    name = F.regexp_replace(last_segment(F.col("_metadata.file_path")), r"\.csv$", "")
    setting = F.when(name == dataset, F.lit(BASE_SETTING)).otherwise(name)
    rows = raw.select("*", setting.alias("setting"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.filter(F.col("setting").rlike(r"^\d\d$"))
    placed = position(rows, ["setting"], ["_block", "_row"], "arrival_seq", limit)
    return placed.select(
        "setting",
        F.col("case:concept:name").alias("case_id"),
        F.col("concept:name").alias("activity"),
        parse_time(F.col("time:timestamp")).alias("event_time"),
        "arrival_seq",
    )


def write_logs(log: DataFrame, path: str) -> None:
    """Logs of all settings as a table with one folder per setting."""
    log.write.partitionBy("setting").parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    schema = "case_id string, activity string, event_time timestamp, arrival_seq bigint, setting string"
    return spark.read.schema(schema).parquet(path)
