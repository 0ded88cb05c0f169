"""Equal timestamps: groups of tied events and their most frequent order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.operators.hotkeys import position

TIE = ["case_id", "ts_ms"]


def tie_sizes(log: DataFrame) -> DataFrame:
    """Timestamps at which a case has more than one event, with the number of events."""
    sizes = log.groupBy("case_id", F.unix_millis("event_time").alias("ts_ms")).agg(F.count(F.lit(1)).alias("n_tied"))
    return sizes.filter("n_tied > 1")


def tied_events(log: DataFrame) -> DataFrame:
    """The events of all tie groups, one row each."""
    return log.withColumn("ts_ms", F.unix_millis("event_time")).join(tie_sizes(log), TIE)


def best_pattern_per_bag(patterns: DataFrame) -> DataFrame:
    """Per bag of activities the most frequent pattern; on equal frequency the first in the order of labels."""
    bag = F.array_sort("pattern").alias("bag")
    ranked = patterns.groupBy(bag).agg(F.min(F.struct((-F.col("freq")).alias("rank"), "pattern")).alias("top"))
    return ranked.select("bag", F.col("top.pattern").alias("pattern"), (-F.col("top.rank")).alias("freq"))


def ordered_events(log: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row per tied event: its place in the group as delivered and as ordered (1-based), and ``freq`` of the pattern if one matches.

    Groups of any size are returned, in the order of the most frequent matching pattern, else as delivered.  Events of one activity
    keep their order.  Only groups no longer than the longest pattern are gathered to look for one: a longer group has none.
    """
    kept = ["arrival_seq", "activity", "n_tied"]
    events = position(tied_events(log).select(*TIE, *kept), TIE, ["arrival_seq"], "delivered_place")
    events = position(events, [*TIE, "activity"], ["arrival_seq"], "_nth")
    best = best_pattern_per_bag(patterns)
    longest = patterns.agg(F.max(F.size("pattern")).alias("_longest"))  # one row
    short = events.join(F.broadcast(longest), F.col("n_tied") <= F.col("_longest"))
    found = short.groupBy(*TIE).agg(F.array_sort(F.collect_list("activity")).alias("bag")).join(best, "bag")
    steps = found.select(*TIE, "freq", "pattern", F.posexplode("pattern").alias("_at", "activity"))
    # the n-th of its activity in the pattern; a pattern is short
    nth = F.size(F.filter(F.slice("pattern", 1, F.col("_at") + 1), lambda a: a == F.col("activity"))).cast("bigint")
    places = steps.select(*TIE, "freq", "activity", nth.alias("_nth"), (F.col("_at") + 1).cast("bigint").alias("_place"))
    out = events.join(places, [*TIE, "activity", "_nth"], "left")
    return out.select(*TIE, *kept, "delivered_place", F.coalesce("_place", "delivered_place").alias("place"), "freq")


def as_groups(events: DataFrame) -> DataFrame:
    """One row per tie group with its activities as ``delivered`` and ``ordered``: each row is as long as its group."""
    by = lambda place: F.transform(F.array_sort(F.collect_list(F.struct(place, "activity"))), lambda s: s["activity"])
    return events.groupBy(*TIE).agg(
        F.max("n_tied").alias("n_tied"), by("delivered_place").alias("delivered"), by("place").alias("ordered"), F.max("freq").alias("freq")
    )
