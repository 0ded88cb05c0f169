"""Names: cases of a swap setting, run labels, file names of result files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold.params import Params

CONTROL_CASE = "test"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def swap_case(setting: Column | str, case: Column) -> Column:
    setting = F.lit(setting) if isinstance(setting, str) else setting
    return F.concat_ws("_", F.lit("swap"), setting, case)


def time_text(ts: Column) -> Column:
    return F.concat(F.date_format(ts, TIME_FORMAT), F.lit("+0000"))


def run_label(log_name: str, p: Params) -> str:
    """Settings of a run as a folder name (fixed values: the parts and their order)."""
    parts = [log_name]
    if not p.event_time_aware:
        parts.append("_notaware_")
    if not p.adapts:
        parts.append("_notadaptable_")
    parts.append({"greedy": "_minitrie_", "ngrams": "_freqrandom_", "none": ""}[p.order])
    return "".join(parts) + f"_{p.min_decay}_{p.multiplier}"


def between(text: Column, left: str, right: str) -> Column:
    """What stands between two marks."""
    return F.split_part(F.split_part(text, F.lit(left), F.lit(2)), F.lit(right), F.lit(1))


def last_segment(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def run_columns(name: Column, kind: str) -> dict[str, Column]:
    """Columns coded in the name of a result file: dataset and settings.

    ``kind`` is orig, noise or ewma; e.g. ``bpi2012__algo_ngrams__swap_10_3_0.3_20240101_120000``.
    """
    dataset = F.split_part(name, F.lit("__"), F.lit(1))
    algo, swap = between(name, "algo_", "__swap"), between(name, "swap_", "_3_0.3")
    return {
        "orig": {"dataset": dataset, "algo": algo, "swap": swap},
        "noise": {"dataset": dataset, "noise": between(name, "noise_", "__algo"), "algo": algo, "swap": swap},
        "ewma": {"dataset": dataset, "ewma": between(name, "ewma_", "__swap"), "swap": between(name, "swap_", "_ngrams")},
    }[kind]
