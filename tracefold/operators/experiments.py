"""Runs over parameter grids and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.labels import last_segment, run_columns
from tracefold.operators.conformance import Model, check
from tracefold.operators.hotkeys import position
from tracefold.params import Params
from tracefold.session import write_through

# fixed values: the parameter grids of the published experiments
ALGORITHMS = {
    "ngrams": Params(order="ngrams"),
    "greedy": Params(order="greedy"),
    "adaptive": Params(),
    "non_adaptive": Params(adaptable=False),
    "non_aware": Params(event_time_aware=False, adaptable=False),
}
SWAPS = ["00", "01", "05", "10", "20", "50", "99"]
EWMA_SWAPS = ["01", "10", "50"]
EWMA_ALPHAS = [0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05]
NOISE = ["05", "10", "20"]
REPETITIONS = 3


def param_grid(spark: SparkSession, datasets: DataFrame, kind: str = "orig") -> DataFrame:
    """All runs of an experiment: the data sets times its settings (a fixed list) times the repetitions."""
    algos, reps = list(ALGORITHMS), list(range(1, REPETITIONS + 1))
    rows = {
        "orig": [("", a, "", s, r) for a in algos for s in SWAPS for r in reps],
        "noise": [(n, a, "", s, r) for n in NOISE for a in algos for s in EWMA_SWAPS for r in reps],
        "ewma": [("", "ngrams", str(al), s, r) for al in EWMA_ALPHAS for s in EWMA_SWAPS for r in reps],
    }[kind]
    grid = spark.createDataFrame(rows, "noise string, algo string, ewma string, swap string, repetition int")
    return datasets.crossJoin(F.broadcast(grid))  # at most 315 settings


def run_grid(logs: dict[str, DataFrame] | DataFrame, model: Model, algorithms: dict[str, Params], dataset: str) -> DataFrame:
    """Every log (swap setting -> log, or one log with the setting in ``swap``) under every algorithm in one job: one row per event and run.

    The logs are one log whose cases carry the setting in their names, so late flags, multipliers and rounds are taken once; the
    adaptive multiplier follows each setting by itself.  A case lies beside itself in the other settings, whose runs share what they have in common.
    """
    if isinstance(logs, dict):
        logs = reduce(DataFrame.unionByName, [log.withColumn("swap", F.lit(swap)) for swap, log in logs.items()])
    whole = logs.withColumn("_case", F.col("case_id")).withColumn("case_id", F.concat_ws("|", "swap", "case_id"))
    names = list(algorithms)
    out = check(write_through(whole, "whole"), model, [algorithms[n] for n in names], ewma_keys=["swap"], near=["_case"])
    label = F.element_at(F.lit(names), F.col("setting") + 1)
    return out.withColumn("algo", label).withColumn("dataset", F.lit(dataset)).drop("setting", "_case")


def write_results(rows: DataFrame, path: str) -> None:
    """Result files without header below ``path``, a folder per ``run``: case, activity, cost, time and emission of every event.

    A case lies in one file, its lines in the order of ``arrival_seq``; files are written by every task.
    """
    ordered = rows.repartition("run", "case_id").sortWithinPartitions("run", "case_id", "arrival_seq")
    ordered.select("run", "case_id", "activity", "cost", "time_ms", "emitted_at_ms").write.partitionBy("run").csv(path)


def read_results(spark: SparkSession, path: str, kind: str = "orig") -> DataFrame:
    """Headerless result files below a folder, with the settings in their names and the order of their lines.

    One file is one run.  ``line`` is the position in the file: its blocks are read in order, so the generated id grows
    along each file.
    """
    raw = (
        spark.read.schema("case_id string, activity string, cost int, time_ms bigint, emitted_at_ms bigint")
        .option("recursiveFileLookup", "true")
        .csv(path)  # also of folders named run=...
        .select("*", F.col("_metadata.file_path").alias("filename"), F.col("_metadata.file_block_start").alias("_block"))
    )
    raw = raw.withColumn("line", F.struct("_block", F.monotonically_increasing_id().alias("n")))
    name = F.regexp_replace(last_segment(F.regexp_replace("filename", r"/(part-[^/]*)$", "")), "^run=", "")
    return raw.drop("_block").withColumns(run_columns(name, kind))


def numbered(results: DataFrame, order: str = "line") -> DataFrame:
    """Row number ``rn`` within each result file, in the order of ``order``, a struct of two numbers; a file of any length is cut where it is long."""
    places = {f"_{i}": F.col(f"{order}.{n}") for i, n in enumerate(results.schema[order].dataType.names)}
    rows = position(results.withColumns(places), ["filename"], list(places), "rn")
    return rows.withColumn("rn", F.col("rn").cast("int")).drop(*places)


def per_case(results: DataFrame, settings: list[str], order: str = "line") -> DataFrame:
    """Per file and case: time, cost after the last event, events."""
    return results.groupBy("case_id", "filename", *settings).agg(
        F.sum("time_ms").alias("total_time_ms"), F.max_by("cost", order).alias("cost"), F.count(F.lit(1)).alias("event_count")
    )


def last_cost(results: DataFrame, order: str = "line") -> DataFrame:
    """Each result row with the last cost of its file and case instead of its own."""
    last = results.groupBy("filename", "case_id").agg(F.max_by("cost", order).alias("cost"))
    return results.drop("cost").join(last, ["filename", "case_id"])


def per_setting(cases: DataFrame, settings: list[str]) -> DataFrame:
    """Per setting: time per event and cost per case; the cases are counted."""
    total = cases.groupBy(*settings).agg(
        F.sum("total_time_ms").alias("total_time_ms"),
        F.sum("cost").alias("cost"),
        F.sum("event_count").alias("event_count"),
        F.count(F.lit(1)).alias("case_count"),
    )
    return total.select(
        "*",
        (F.col("total_time_ms") / F.col("event_count")).alias("time_per_event_ms"),
        (F.col("cost") / F.col("case_count")).alias("cost_per_trace"),
    )


def write_summary(df: DataFrame, path: str, order: list[str]) -> None:
    """Summary as CSV with header, sorted only here."""
    df.orderBy(*order).write.option("header", "true").csv(path)


def active_cases(log: DataFrame, n: int) -> DataFrame:
    """The ``n`` cases seen last; the others would be evicted."""
    last = log.groupBy("case_id").agg(F.max("arrival_seq").alias("last_seen"))
    ranked = position(last.withColumn("_age", -F.col("last_seen")), [], ["_age"], "recency")
    return ranked.filter(F.col("recency") <= n).select("case_id", "last_seen", "recency")
