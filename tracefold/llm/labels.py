"""Labelled documents for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.session import write_through


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no classifier may learn from; a missing id is none of them."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int | None = None) -> DataFrame:
    """doc_id, text and label (0 or 1) of the rows to learn from, written once: texts are moved a single time to meet their labels, however few those are.

    ``most``: learn from about so many labels at most.  They are drawn before they meet any text, so they are few enough to broadcast and no text is moved;
    drawn labels without a document are not replaced.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = known.where(~held_out())
    known = known.hint("merge") if most is None else F.broadcast(sample(known, most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out()).join(known, "doc_id")
    return write_through(rows, "labelled")


def sample(rows: DataFrame, most: int) -> DataFrame:
    """All of ``rows`` if there are at most ``most``, else about so many, drawn by a hash of their ids."""
    return share(rows, most, rows.count())


def share(rows: DataFrame, most: int, n: int) -> DataFrame:
    """About ``most`` of ``n`` rows: those whose 64-bit hash is under that share of its range, so any share is drawn as it is."""
    return rows if n <= most else rows.where(F.xxhash64("doc_id") < F.lit(-(2**63) + 2**64 * most // n))
