"""XES event logs, plain or gzip (chosen by the file suffix)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators.hotkeys import position

DEFAULT_KEY = "concept:name"
TIME_KEY = "time:timestamp"
_KINDS = ["string", "int", "float", "boolean", "id", "date"]
_ATTRIBUTES = ", ".join(f"`{k}`: array<struct<_key: string, _value: string>>" for k in _KINDS)
SCHEMA = f"string array<struct<_key: string, _value: string>>, event array<struct<{_ATTRIBUTES}>>"


def classifier_key(spark: SparkSession, path: str) -> str:
    """First key of the first classifier in the header, else the concept name."""
    found = spark.read.format("xml").option("rowTag", "classifier").schema("_name string, _keys string").load(path)
    first = found.filter("_keys is not null").limit(1).collect()
    return first[0]["_keys"].strip().split(" ")[0] if first else DEFAULT_KEY


def _attribute(lists: list[Column], key: str) -> Column:
    return F.coalesce(*[F.filter(a, lambda x: x["_key"] == key).getItem(0)["_value"] for a in lists])


def read_xes(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The log's events in document order: ``arrival_seq`` is built from the places of trace and event in the file."""
    key = classifier_key(spark, path)
    traces = spark.read.format("xml").option("rowTag", "trace").schema(SCHEMA).load(path)
    # block start and running id grow along the file, whatever tasks read it
    traces = traces.select("*", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    names = traces.select(_attribute([F.col("string")], DEFAULT_KEY).alias("case_id"), "event", "_block", "_row")
    placed = position(names, [], ["_block", "_row"], "_trace", limit)
    events = placed.select("case_id", "_trace", F.posexplode("event").alias("_pos", "e"))
    time = F.try_to_timestamp(_attribute([F.col("e.date")], TIME_KEY))
    return events.select(
        "case_id",
        _attribute([F.col(f"e.{k}") for k in _KINDS], key).alias("activity"),
        time.alias("event_time"),
        (F.shiftleft(F.col("_trace"), 31) + F.col("_pos")).alias("arrival_seq"),
    )
