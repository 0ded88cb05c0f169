"""Stream sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.sources.messages import MESSAGE_SCHEMA, parse_messages


def message_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Messages that arrive as JSON files with topic, payload and arrival_seq."""
    reader = spark.readStream.schema(MESSAGE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_messages(reader.json(path))


def message_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Messages from Kafka (needs Spark's Kafka package): the key is the message topic, the offset the delivery order.

    Producers must send one case to one partition, as offsets only order a partition.
    """
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return parse_messages(
        raw.select(F.col("key").cast("string").alias("topic"), F.col("value").cast("string").alias("payload"), F.col("offset").alias("arrival_seq"))
    )


def write_responses(results: DataFrame, path: str, checkpoint: str, kind: str = "parquet", all_available: bool = False):
    """Start the sink; files are written by every task.

    ``all_available`` stops when the present input is done.  Batches without data are off for it: a time-to-live would ask for
    one after the other and the query would never end.
    """
    writer = results.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if not all_available:
        return writer.start()
    conf, name = results.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
