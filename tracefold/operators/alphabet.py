"""Alphabet: activity labels and their dense symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.operators.hotkeys import position

FIRST_SYMBOL = 65  # fixed value: symbols count up from here


def alphabet(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct activities with a symbol by first sight in delivery order."""
    first = log.groupBy("activity").agg(F.min("arrival_seq").alias("first_seen"))
    ranked = position(first, [], ["first_seen"], "n", limit)
    return ranked.select("activity", (F.col("n") + FIRST_SYMBOL - 1).alias("symbol"))


def encode(log: DataFrame, dim: DataFrame) -> DataFrame:
    """Adds ``symbol``; null for an activity that the alphabet does not have."""
    return log.join(dim, "activity", "left")


def decode_moves(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """``key`` and ``moves`` with labels in place of symbols, by joins with the alphabet: one row per key, each as long as its alignment."""
    label = lambda side: dim.select(F.col("symbol").alias(side), F.col("activity").alias(f"{side}_label"))
    each = df.select(key, F.posexplode("moves").alias("_at", "m")).select(key, "_at", "m.log", "m.model", "m.cost")
    named = each.join(label("log"), "log", "left").join(label("model"), "model", "left")
    move = F.struct("_at", F.struct(F.col("log_label").alias("log"), F.col("model_label").alias("model"), "cost").alias("m"))
    return named.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(move)), lambda x: x["m"]).alias("moves"))


def decode(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Adds ``label`` to a ``symbol``."""
    return df.join(dim.withColumnRenamed("activity", "label"), "symbol", "left")
