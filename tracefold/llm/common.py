"""What several operators share: tables, grouping of skewed keys, Arrow batches as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of the contracts: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that a Python step gets at once; a longer text comes alone.
STEP_BYTES = 2_000_000
#: Pieces into which the rows of one key are dealt before they are totalled.
SALTS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def group_values(rows: DataFrame, keys: list[str], parts: dict[str, Column], totals: dict[str, Column], salt_by: list[str]) -> DataFrame:
    """``rows`` with one more column per entry of ``totals``, the value over all rows that share ``keys``.

    ``parts`` are aggregates over some rows of a key, ``totals`` aggregates over the parts.  A key with very many rows is dealt by ``salt_by`` into
    ``SALTS`` pieces, each totalled on its own; only the totals of the pieces meet, and each row joins the row of its own piece.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int"))
    pieces = salted.groupBy(*keys, "_salt").agg(*[c.alias(f"_{n}") for n, c in parts.items()])
    all_of_key = Window.partitionBy(*keys)
    known = pieces.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_salt").alias("_s"),
        *[c.over(all_of_key).alias(n) for n, c in totals.items()],
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_salt") == F.col("_s")]
    return salted.join(known, on).select(*[F.col(c) for c in rows.columns], *totals)


def small_batches(batch: pa.RecordBatch, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``step_bytes`` of text."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    sums, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + step_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str | StructType, step_bytes: int = STEP_BYTES) -> DataFrame:
    """A column mapping in Python: ``make`` runs once per task, what it returns gets slices of the rows and returns the columns of ``schema``."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = kind.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, step = to_arrow_schema(kind), make()
        for batch in (b for whole in batches for b in small_batches(whole, step_bytes)):
            if batch.num_rows:
                got = step(batch)
                yield pa.RecordBatch.from_arrays([pa.array(got[n], type=out.field(n).type) if not isinstance(got[n], pa.Array) else got[n].cast(out.field(n).type) for n in names], schema=out)

    return df.mapInArrow(run, kind)


def free_mark(docs: DataFrame) -> str:
    """A beginning that no column of ``docs`` has, for names of columns put beside its own."""
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    return mark


def one_row_each(kept: DataFrame, ids: list[str], ties: str) -> DataFrame:
    """``kept`` with a single row of each ``ids`` where ``ties``, the known number of such rows, is over one; other rows are not moved."""
    single = kept.where(F.col(ties) <= 1)
    return single.unionByName(kept.where(F.col(ties) > 1).dropDuplicates(ids))
