"""Delivered messages: topic and JSON payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.labels import CONTROL_CASE, time_text

MESSAGE_SCHEMA = "topic string, payload string, arrival_seq bigint"


def parse_time(text: Column) -> Column:
    """ISO time with any usual fraction; the offset may be written +0000 or +00:00."""
    return F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d\d)(\d\d)$", "$1:$2"))


def parse_messages(df: DataFrame) -> DataFrame:
    """The last two segments of the topic are case and activity; the time is in the payload.  Control messages are dropped."""
    parts = F.split("topic", "/")
    return df.select(
        F.try_element_at(parts, F.lit(-2)).alias("case_id"),
        F.try_element_at(parts, F.lit(-1)).alias("activity"),
        parse_time(F.get_json_object("payload", "$.event['time:timestamp']")).alias("event_time"),
        "arrival_seq",
    ).filter(~F.col("case_id").eqNullSafe(CONTROL_CASE))


def _fault() -> Column:
    """Why an event can't be taken; null for one that can."""
    empty = lambda c: F.col(c).isNull() | (F.length(c) == 0)
    return (
        F.when(empty("case_id"), "no case").when(empty("activity"), "no activity").when(F.col("event_time").isNull(), "no time")
        .when(F.col("arrival_seq").isNull(), "no place in the delivery order")
    )


def usable(log: DataFrame) -> DataFrame:
    """The events that a checker takes, of a batch or a stream: those with case, activity, time and place in the delivery order."""
    return log.filter(_fault().isNull())


def rejected(log: DataFrame) -> DataFrame:
    """The other events, with the first ``reason``: for a sink of their own beside the results."""
    return log.withColumn("reason", _fault()).filter("reason IS NOT NULL")


def as_messages(log: DataFrame, base: str = "stream") -> DataFrame:
    """The messages a producer would publish for a log."""
    event = F.struct(F.col("activity").alias("concept:name"), time_text(F.col("event_time")).alias("time:timestamp"))
    payload = F.to_json(F.struct(event.alias("event"), F.struct(F.col("case_id").alias("concept:name")).alias("trace")))
    return log.select(
        F.concat_ws("/", F.lit(base), "case_id", "activity").alias("topic"), payload.alias("payload"), "arrival_seq"
    )
