"""Alignments as ``array<struct<log string, model string, cost int>>``; a null label is a skip."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SKIP = ">>"  # how a skip is written in text


def move(log: Column, model: Column) -> Column:
    """One move; costs 1 if one side is skipped."""
    cost = F.when(log.isNull() | model.isNull(), 1).otherwise(0)
    return F.struct(log.cast("string").alias("log"), model.cast("string").alias("model"), cost.cast("int").alias("cost"))


def append(alignment: Column, log: Column, model: Column) -> Column:
    return F.concat(alignment, F.array(move(log, model)))


def total_cost(alignment: Column) -> Column:
    return F.aggregate(alignment, F.lit(0), lambda acc, m: acc + m["cost"])


def trace_size(alignment: Column) -> Column:
    return F.size(F.filter(alignment, lambda m: m["log"].isNotNull()))


def model_size(alignment: Column) -> Column:
    return F.size(F.filter(alignment, lambda m: m["model"].isNotNull()))


def _projection(alignment: Column, side: str) -> Column:
    return F.array_join(F.transform(F.filter(alignment, lambda m: m[side].isNotNull()), lambda m: F.trim(m[side])), "")


def log_projection(alignment: Column) -> Column:
    return _projection(alignment, "log")


def model_projection(alignment: Column) -> Column:
    return _projection(alignment, "model")


def move_text(m: Column) -> Column:
    skip = F.lit(SKIP)
    # not format_string, which takes most of the time of a long alignment's text
    cost = F.coalesce(m["cost"].cast("string"), F.lit("null"))
    return F.concat(F.lit("[logMove:"), F.coalesce(m["log"], skip), F.lit(", modelMove:"), F.coalesce(m["model"], skip), F.lit(", cost:"), cost, F.lit("]"))


def text(alignment: Column) -> Column:
    """Every move followed by a bar."""
    return F.array_join(F.transform(alignment, lambda m: F.concat(move_text(m), F.lit("|"))), "")


def parse(txt: Column) -> Column:
    """``Sync x >> Insertion y >> Deletion z``; parts of another kind are left out."""
    parts = F.transform(F.split(txt, SKIP), lambda m: F.trim(m))
    none = F.lit(None).cast("string")

    def one(m):
        label = lambda kind: F.trim(F.replace(m, F.lit(kind), F.lit("")))
        return (
            F.when(m.startswith("Sync"), move(label("Sync"), label("Sync")))
            .when(m.startswith("Insertion"), move(label("Insertion"), none))
            .when(m.startswith("Deletion"), move(none, label("Deletion")))
        )

    return F.filter(F.transform(parts, one), lambda m: m.isNotNull())


def decode(alignment: Column, labels: Column) -> Column:
    """Replace symbols by labels; ``labels`` is a map from symbol to label as large as the alphabet."""
    back = lambda s: F.when(s.isNotNull(), F.try_element_at(labels, s))
    return F.transform(alignment, lambda m: F.struct(back(m["log"]).alias("log"), back(m["model"]).alias("model"), m["cost"].alias("cost")))
