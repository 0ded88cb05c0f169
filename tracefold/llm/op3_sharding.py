"""Uniform shuffle of all rows into shards of exact size by a hypergeometric communication matrix.

A uniform permutation sends from source file i to target j a number of rows that follows, given the sizes, a multivariate hypergeometric law.  So the
matrix of these numbers is drawn first; then each source permutes its rows and deals them by its row of the matrix, rows are exchanged, and each target permutes what it got.
Targets are lanes: equal parts of a shard that one task orders.  Nobody holds the matrix: it is split in halves of sources again and again with seeded
draws, so a task works out the row of its own source in log2(sources) draws.

``law``: "rows", shard sizes differ by one at most.  The rows are written to the shared folder first, which gives each a fixed place (file, row) however often
a task is run again.  Nulls, repeated rows and further columns don't matter: rows are moved by place, never by value.  ``grown_shard`` is null under this law.
"""

from __future__ import annotations

from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm.common import free_mark, map_batches, table
from tracefold.session import with_fields, write_through

#: Rows, and about how many bytes, that one task orders at the receiving end.
LANE_ROWS, LANE_BYTES = 200_000, 128_000_000
#: numpy draws hypergeometric numbers of fewer rows than this.
NUMPY_MOST = 1_000_000_000
#: Stirling's series: B(2k) / (2k (2k - 1)) as fractions, and ln(2 pi) / 2.
STIRLING = [(1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400), (43867, 244188), (-174611, 125400)]
HALF_LN_2PI = Decimal("0.91893853320467274178032973640561763986139747363778341281715")


def matrix_row(sizes: np.ndarray, targets: np.ndarray, source: int, seed: int) -> np.ndarray:
    """Rows that ``source`` sends to each target.  ``sizes`` and ``targets`` have the same sum."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    low, high, open_ = 0, len(sizes), targets.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        draw = np.random.default_rng([seed, low, high])
        first = _large(open_, int(sums[middle] - sums[low]), draw)
        low, high, open_ = (low, middle, first) if source < middle else (middle, high, open_ - first)
    return open_


def _log_factorial(n: int) -> Decimal:
    """ln n! to about 35 digits, by Stirling's series behind a shift."""
    up = Decimal(1)
    while n < 64:
        n += 1
        up *= n
    x = Decimal(n)
    series = sum((Decimal(a) / b / x ** (2 * k + 1) for k, (a, b) in enumerate(STIRLING)), Decimal(0))
    return (x + Decimal("0.5")) * x.ln() - x + HALF_LN_2PI + series - up.ln()


def hypergeometric(good: int, bad: int, take: int, draw: np.random.Generator) -> int:
    """Good ones among ``take`` drawn, for any size: ratio-of-uniforms rejection, with the law itself worked out to 35 digits."""
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    total, mode = good + bad, (good + 1) * (take + 1) // (good + bad + 2)
    mean = take * (good / total)
    spread = (mean * (bad / total) * ((total - take) / max(1, total - 1)) + 0.5) ** 0.5
    wide = 2 * (2 / np.e) ** 0.5 * spread + 3 - 2 * (3 / np.e) ** 0.5
    with localcontext() as places:
        places.prec = 50

        def law(k: int) -> Decimal:
            return -sum(_log_factorial(n) for n in (k, good - k, take - k, bad - take + k))

        top = law(mode)
        while True:
            u, v = draw.random(2).tolist()
            if u > 0:
                k = int(np.floor(mean + 0.5 + wide * (v - 0.5) / u))
                if low <= k <= high and 2 * Decimal(u).ln() <= law(k) - top:
                    return k


def _large(left: np.ndarray, take: int, draw: np.random.Generator, limit: int = NUMPY_MOST) -> np.ndarray:
    """The same draw where numpy's limit is passed: halves of the targets, until each part is below it."""
    total, cut = int(left.sum()), len(left) // 2
    if len(left) == 1:
        return np.array([take], np.int64)
    if total < limit:
        return draw.multivariate_hypergeometric(left, take, method="marginals")
    good = int(left[:cut].sum())
    first = hypergeometric(good, total - good, take, draw)
    return np.concatenate([_large(left[:cut], first, draw, limit), _large(left[cut:], take - first, draw, limit)])


def equal_parts(rows: int, parts: int) -> np.ndarray:
    return np.full(parts, rows // parts, np.int64) + (np.arange(parts) < rows % parts)


def _row_bytes(docs: DataFrame) -> Column:
    """About the bytes of a row: those of texts, and eight for any other value."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8) if "<" not in kind else F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c, kind in docs.dtypes]
    return sum(sizes, F.lit(0)).cast("long")


def shards(docs: DataFrame, n: int = 16, seed: int = 17) -> DataFrame:
    """``docs`` with law, shard, slot (place in the shard) and grown_shard; columns of these names are replaced.

    The result depends on ``seed``, on the rows of each source file and on the order of these files, not on their names: the same partitions give the same slots.
    """
    spark, mark = docs.sparkSession, free_mark(docs)
    own = [c for c in docs.columns if c not in ("law", "shard", "slot", "grown_shard")]
    file, row, lane, start, key, source = (mark + c for c in ("file", "row", "lane", "start", "key", "source"))
    stored = write_through(docs.select(*own), "shards").select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    found = stored.groupBy(file).agg(F.count("*").alias("n"), F.sum(_row_bytes(stored.select(*own))).alias("bytes")).collect()
    counted = sorted((r[file], r["n"]) for r in found)
    sizes = np.array([c for _, c in counted], np.int64)
    per_shard = equal_parts(int(sizes.sum()), n)
    # rows go to lanes at random, so lanes of equal rows have about equal bytes
    lane_rows = max(1, min(LANE_ROWS, LANE_BYTES * int(sizes.sum()) // max(1, sum(r["bytes"] for r in found))))
    lanes = np.maximum(1, -(-per_shard // lane_rows))
    shard_of = np.repeat(np.arange(n), lanes)
    targets = np.concatenate([equal_parts(int(r), int(k)) for r, k in zip(per_shard, lanes, strict=True)])
    starts = np.concatenate([np.cumsum(np.concatenate([[0], targets[shard_of == s][:-1]])) for s in range(n)])
    plan = spark.sparkContext.broadcast(({f: i for i, (f, _) in enumerate(counted)}, sizes, targets, shard_of, starts))
    schema = with_fields(stored.schema, f"`{lane}` int, shard int, `{start}` long, `{key}` long, `{source}` int")

    def make():
        files, sizes, targets, shard_of, starts = plan.value
        now: list = [None]

        def permuted(name: str) -> tuple[int, np.ndarray, np.ndarray]:
            """(number of a source, lane and key of each of its rows): worked out once for the source that is being read."""
            if now[0] != name:
                i = files[name]
                order = np.random.default_rng([seed, i, 1]).permutation(int(sizes[i]))
                now[:] = name, (i, np.repeat(np.arange(len(targets)), matrix_row(sizes, targets, i, seed))[order], np.random.default_rng([seed, i, 2]).permutation(int(sizes[i])))
            return now[1]

        def step(batch: pa.RecordBatch) -> dict:
            rows = np.asarray(batch.column(batch.schema.get_field_index(row)))
            names = batch.column(batch.schema.get_field_index(file)).dictionary_encode()
            at, keys, sources = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for k, name in enumerate(names.dictionary.to_pylist()):
                here = np.asarray(names.indices) == k
                i, lane_of, key_of = permuted(name)
                at[here], keys[here], sources[here] = lane_of[rows[here]], key_of[rows[here]], i
            out = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            return out | {lane: pa.array(at), "shard": pa.array(shard_of[at]), start: pa.array(starts[at]), key: pa.array(keys), source: pa.array(sources)}

        return step

    # the second permutation: by a hash of the place, ties by the place itself
    again = Window.partitionBy(lane).orderBy(F.xxhash64(F.lit(seed), key, source), source, row)
    moved = map_batches(stored, make, schema).withColumn("slot", F.col(start) + F.row_number().over(again) - 1)
    return moved.select(*own, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    # the digests are taken of the rows that arrive
    return shards(table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), "law", "shard", "slot", "grown_shard"
    )


QUERIES = {"op3_sharding": op3_sharding}
SQL: dict[str, str] = {}
