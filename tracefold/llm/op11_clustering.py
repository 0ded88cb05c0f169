"""Centroid clustering over subvector dictionaries: exact integer distances, summed by code.

1. ``encode``: vectors become whole numbers floor(SCALE * x) and are taken together in chunks of at most ``CHUNK``.  In a chunk each block of ``BLOCK`` dimensions is
   dictionary-encoded without loss: its distinct subvectors, and per vector the code of its own.  The chunks are written once; no vector is moved again.
2. A round works out the squared distances between the distinct subvectors of each block and the centroids' subvectors once per chunk, then adds up, for each
   vector, the entries that its codes name (``Chunk.nearest``).  A vector's components are not looked at any more.
3. New centroids need sums of components.  These come from counts of (cluster, code) times the dictionary, so a chunk sends one row per cluster (``_sums``), and
   the driver gets one row per cluster: k rows of 64 numbers, whatever the number of vectors.

Kept are vectors with exactly ``dims`` components, none null or non-finite.  Components beyond +-2**21 have no squared distance that fits a long: such vectors are left
out like non-finite ones.  First centroids: the k kept vectors with the smallest sha256 of "seed:vec_id"; of repeated ids the smaller vectors come first, vectors without
an id come last.  With fewer than k kept vectors there are fewer clusters, with none the result is empty.  Ties of distance go to the smaller cluster, empty
clusters stay where they are.  Repeated rows count as often as they occur; a null vec_id is kept as null.  Further columns are not read.  Inertias beyond a
long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import table
from tracefold.session import write_through

DIMS, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Dimensions of a block; vectors of a chunk (codes of a block fit 16 bits).
BLOCK, CHUNK = 2, 32_768
#: Largest component: dims * (2 * SCALE * LARGEST)**2 is below 2**63.
LARGEST = 2.0**21
CHUNKS = "ids binary, known binary, codes binary, sizes array<int>, subvectors binary"


def whole_numbers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(scale * x.astype(np.float64)).astype(np.int64)


def kept_vectors(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    fits = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST))  # NaN is above every number
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.coalesce((F.size("embedding") == dims) & fits, F.lit(False)))


class Chunk:
    """Vectors as codes into the distinct subvectors of each block."""

    def __init__(self, codes: np.ndarray, dictionaries: list[np.ndarray]):
        self.codes, self.dictionaries = codes, dictionaries

    @classmethod
    def of(cls, numbers: np.ndarray, block: int = BLOCK) -> Chunk:
        codes, dictionaries = [], []
        for at in range(0, numbers.shape[1], block):
            part = np.ascontiguousarray(numbers[:, at : at + block])
            distinct, code = np.unique(part, axis=0, return_inverse=True)
            dictionaries.append(distinct)
            codes.append(code.ravel().astype(np.uint16))
        return cls(np.array(codes).T, dictionaries)

    def row(self) -> dict:
        """codes, sizes and subvectors as they are stored: subvectors of all blocks one after the other."""
        flat = [d.ravel() for d in self.dictionaries]
        return {"codes": self.codes.tobytes(), "sizes": [len(d) for d in self.dictionaries], "subvectors": np.concatenate(flat).astype(np.int64).tobytes()}

    @classmethod
    def load(cls, row: dict, dims: int) -> Chunk:
        sizes, flat, out, at = row["sizes"], np.frombuffer(row["subvectors"], np.int64), [], 0
        block = -(-dims // len(sizes))
        for i, size in enumerate(sizes):
            width = min(block, dims - i * block)
            out.append(flat[at : at + size * width].reshape(size, width))
            at += size * width
        return cls(np.frombuffer(row["codes"], np.uint16).reshape(-1, len(sizes)), out)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) per vector."""
        total, at = np.zeros((len(self.codes), len(centroids)), np.int64), 0
        for i, subvectors in enumerate(self.dictionaries):
            apart = subvectors[:, None, :] - centroids[None, :, at : at + subvectors.shape[1]]
            total += (apart * apart).sum(axis=2)[self.codes[:, i]]
            at += subvectors.shape[1]
        cluster = total.argmin(axis=1)
        return cluster, total[np.arange(len(total)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Sums of components by cluster, from how often each cluster has each code."""
        out = []
        for i, subvectors in enumerate(self.dictionaries):
            times = np.bincount(cluster * len(subvectors) + self.codes[:, i], minlength=k * len(subvectors)).reshape(k, -1)
            out.append(times.astype(np.int64) @ subvectors)
        return np.hstack(out)


def encode(kept: DataFrame, scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """Chunks of the kept vectors, each one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            held = pa.Table.from_batches(rows)
            ids = held["vec_id"].combine_chunks()
            numbers = whole_numbers(np.asarray(held["embedding"].combine_chunks().flatten()).reshape(-1, dims), scale)
            row = Chunk.of(numbers).row() | {"ids": np.asarray(ids.fill_null(0)).tobytes(), "known": np.asarray(ids.is_valid()).tobytes()}
            kinds = [("ids", pa.binary()), ("known", pa.binary()), ("codes", pa.binary()), ("sizes", pa.list_(pa.int32())), ("subvectors", pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in kinds], [n for n, _ in kinds])

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, CHUNK - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == CHUNK:
                    yield chunk(held)
                    held, n = [], 0
        if n:
            yield chunk(held)

    return kept.mapInArrow(run, CHUNKS)


def _each(chunks: DataFrame, centroids: np.ndarray, dims: int, answer, schema: str) -> DataFrame:
    """``answer(row, chunk, cluster, distance)`` of every chunk, as columns of ``schema``.  The centroids are k vectors."""
    shared = chunks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Chunk.load(row, dims)
                yield pa.RecordBatch.from_pydict(answer(row, chunk, *chunk.nearest(shared.value)))

    return chunks.mapInArrow(run, schema)


def _sums(chunks: DataFrame, centroids: np.ndarray, dims: int) -> dict[int, tuple[int, list[int]]]:
    """(vectors, sums of components) by cluster, of clusters that have vectors: at most k rows."""

    def answer(_: dict, chunk: Chunk, cluster: np.ndarray, __: np.ndarray) -> dict:
        k = len(centroids)
        count, total = np.bincount(cluster, minlength=k), chunk.sums(cluster, k)
        used = np.flatnonzero(count)
        return {"cluster": pa.array(used, pa.int32()), "n": pa.array(count[used]), "total": pa.array(total[used].tolist(), pa.list_(pa.int64()))}

    parts = _each(chunks, centroids, dims, answer, "cluster int, n long, total array<long>")
    # sums of many chunks may pass a long
    total = F.array(*[F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(dims)])
    return {r["cluster"]: (r["n"], [int(x) for x in r["total"]]) for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), total.alias("total")).collect()}


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED, scale: int = SCALE) -> np.ndarray:
    """The k vectors with the smallest hashes, in the order of these."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(order.asc_nulls_last(), F.transform("embedding", lambda x: F.floor(scale * x))).limit(k).collect()
    return np.array([whole_numbers(np.array(r["embedding"]), scale) for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster and squared distance of every kept vector; the centroids)."""
    kept = kept_vectors(vectors, dims)
    centroids = first_centroids(kept, k, seed, scale).reshape(-1, dims)
    chunks = write_through(encode(kept, scale, dims), "chunks")
    for _ in range(rounds if len(centroids) else 0):
        for i, (n, total) in _sums(chunks, centroids, dims).items():
            centroids[i] = [t // n for t in total]

    def answer(row: dict, _: Chunk, cluster: np.ndarray, distance: np.ndarray) -> dict:
        known = np.frombuffer(row["known"], bool)
        return {"vec_id": pa.array(np.frombuffer(row["ids"], np.int64), mask=~known), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance)}

    return _each(chunks, centroids, dims, answer, "vec_id long, cluster int, distance long"), centroids


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(table(spark, sf_dir, "embeddings"))
    assigned = write_through(assigned, "assigned")
    named = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    # one row per cluster: k at most
    per = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = assigned.agg(F.try_sum("distance").alias("inertia")).first()["inertia"]
    sha = spark.createDataFrame(named, "cluster int, centroid_sha256 string")
    out = assigned.join(F.broadcast(per.join(F.broadcast(sha), "cluster")), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")


def sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> str:
    """The same in DuckDB SQL."""
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [f"""
v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) <= {int(LARGEST)})) = {dims}),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR) NULLS LAST, x) - 1)::INTEGER AS cluster, x FROM v QUALIFY cluster < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT row, arg_min(c.cluster, (d, c.cluster)) AS cluster, min(d) AS distance FROM (SELECT v.row, c.cluster, {apart} AS d FROM v, c{r} c) c GROUP BY row)")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT cluster, i, sum(v.x[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (row), unnest(range(1, {dims} + 1)) u(i) GROUP BY cluster, i),
m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY cluster),
c{r + 1} AS (SELECT cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (row) JOIN c{rounds} c USING (cluster)"""


QUERIES = {"op11_clustering": op11_clustering}
SQL = {"op11_clustering": sql()}
