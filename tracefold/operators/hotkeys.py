"""Running values per key that do not put a hot key into one task.

A key with more rows than ``limit`` is cut into consecutive ranges ("chunks") of the order.  Running values are
computed inside each chunk; what the earlier chunks of the key contribute is added from a small table of chunk totals.
Keys below the limit keep a plain window.  With no key columns the whole log counts as one hot key, so a global
running value never needs a single-partition window on a large log.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.session import write_through

HOT_ROWS = 5_000_000
GLOBAL_ROWS = 1_000_000
MAX_CHUNKS = 1024
MAX_BROADCAST_KEYS = 100_000
CHUNK = "_chunk"

_AGG = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min, "xor": F.bit_xor}
_MERGE = {
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "xor": lambda a, b: F.coalesce(a, F.lit(0).cast("bigint")).bitwiseXOR(F.coalesce(b, F.lit(0).cast("bigint"))),
}


def _as_number(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name].startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name)


def with_chunks(df: DataFrame, keys: list[str], order: list[str], limit: int | None = None):
    """Cut hot keys: returns (df with the column ``_chunk``, True), or (df unchanged, False) if no key is hot.

    ``order`` is one or two numeric or timestamp columns, not null.  The bounds are approximate quantiles: they only
    decide how even the chunks are, never which value a row gets.
    """
    if limit is None:
        limit = HOT_ROWS if keys else GLOBAL_ROWS
    total = df.count()
    if total <= limit:
        return df, False
    a, b = _as_number(df, order[0]), _as_number(df, order[-1])
    stats = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(a).alias("_a0"), F.min(b).alias("_b0"), F.max(b).alias("_b1"))
        .filter(F.col("_n") > limit)
    )
    hot = write_through(stats, "hotkeys")  # fewer than total / limit rows
    if hot.isEmpty():
        return df, False
    few = total // limit <= MAX_BROADCAST_KEYS
    # monotone in (order[0], order[1]): rows of equal position stay together
    spread = F.lit(1.0) + F.col("_b1") - F.col("_b0")
    place = (a - F.col("_a0")) + (b - F.col("_b0")) / spread
    grid = F.lit([i / MAX_CHUNKS for i in range(1, MAX_CHUNKS)])
    hot_rows = _join(df.select(*keys, *order), hot, keys, "inner", few).withColumn("_f", place.cast("double"))
    cuts = hot_rows.groupBy(*keys).agg(F.percentile_approx("_f", grid, F.lit(10_000)).alias("_q"), F.first("_n").alias("_n"))
    # written tables: the input is read again for totals and values, its plan must not be repeated each time
    step = F.ceil(F.lit(MAX_CHUNKS) / F.greatest(F.lit(2), F.least(F.lit(MAX_CHUNKS), F.ceil(2 * F.col("_n") / limit))))
    cuts = cuts.withColumn("_step", step).select(
        *keys, F.expr("array_distinct(filter(_q, (x, i) -> (i + 1) % _step = 0))").alias("_cuts")
    )
    cuts = write_through(cuts, "cuts")
    marked = _join(_join(df, hot, keys, "left", few), cuts, keys, "left", few).withColumn("_f", place.cast("double"))
    if keys:
        marked = marked.withColumn(CHUNK, F.coalesce(F.expr("size(filter(_cuts, x -> x < _f))"), F.lit(0)))
    else:  # every row has the same cuts, which grow with the log: searched by halves
        splits = [-math.inf, *cuts.first()["_cuts"], math.inf]
        marked = Bucketizer(splits=splits, inputCol="_f", outputCol=CHUNK).transform(marked).withColumn(CHUNK, F.col(CHUNK).cast("int"))
    return write_through(marked.drop("_n", "_a0", "_b0", "_b1", "_cuts", "_f"), "chunks"), True


def _join(df: DataFrame, small: DataFrame, keys: list[str], how: str, few: bool) -> DataFrame:
    """Join with a table that has a row per hot key: broadcast if they are ``few``, else AQE splits the hot keys of the shuffle."""
    small = F.broadcast(small) if few else small
    return df.join(small, keys, how) if keys else df.crossJoin(small)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    aggs: dict[str, tuple[str, Column]],
    limit: int | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Running aggregates over ``keys`` in ``order`` (unique within a key).

    ``aggs`` maps a new column to (kind, input) with kind in count, sum, max, min, xor.  ``exclusive`` leaves out the
    current row.
    """
    df, cut = with_chunks(df, keys, order, limit)
    part = [*keys, CHUNK] if cut else keys
    frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    out = df.select("*", *[_AGG[kind](col).over(frame).alias(name) for name, (kind, col) in aggs.items()])
    if cut:
        totals = df.groupBy(*part).agg(*[_AGG[kind](col).alias(f"_t_{n}") for n, (kind, col) in aggs.items()])
        before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        if keys:  # only cut keys have a second chunk
            cut_keys = totals.filter(F.col(CHUNK) > 0).select(*keys).distinct()
            totals = totals.join(cut_keys, keys, "left_semi")
        carry = totals.select(
            *part, *[_CARRY[kind](F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (kind, _) in aggs.items()]
        )
        out = out.join(carry, part, "left")  # a row per chunk of a cut key: broadcast by size
        for n, (kind, _) in aggs.items():
            out = out.withColumn(n, _MERGE[kind](F.col(n), F.col(f"_c_{n}"))).drop(f"_c_{n}")
    return out.drop(CHUNK)


_CARRY = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min, "xor": F.bit_xor}


def position(df: DataFrame, keys: list[str], order: list[str], name: str = "pos", limit: int | None = None) -> DataFrame:
    """1-based position of each row within its key."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, limit)


def with_totals(df: DataFrame, keys: list[str], aggs: dict[str, Column], limit: int = HOT_ROWS) -> DataFrame:
    """Per-key aggregates on every row.  AQE splits a skewed key of this join; the totals have one row per key."""
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys)
