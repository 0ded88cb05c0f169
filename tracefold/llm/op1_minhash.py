"""Near-duplicates by SetSketch registers: band register values, estimate jointly by likelihood, then verify on the full sets.

A document's set: distinct shingles of ``size`` words (``SHINGLE`` in the query; A-Z lower-cased; fewer words: the whole sequence), as 64-bit hashes.  Each shingle sends a
Poisson stream of arrivals to ``REGISTERS`` registers; a register keeps its first arrival on a scale of powers of ``B`` (truncated at 0 and 65535).  Registers of a
union are maxima, and two registers agree with about the Jaccard similarity.

1. Rows with equal sets form one class, whose smallest doc_id stands for it (``classes``).
2. ``ROWS`` registers make a band; documents that share a band are candidates.  At similarity 0.8 all ``BANDS`` bands differ with probability 3e-6.
3. A bucket is never expanded into its pairs.  First each member is compared with the first one of its bucket, and links are joined to components.  What is
   left are buckets with several components: there, members outside the main component are compared with the members of other components, in blocks
   (``remaining``).  So every pair that shares a band is compared or in one component already.
4. Candidates are screened by the likelihood of J given both set sizes and the numbers of registers that are greater, smaller and equal;
   those not below ``SCREEN`` (five standard errors under the limit) are verified on their texts.

Null and empty texts have an empty set: linked with nothing, each its own component.  A null doc_id takes its component from rows with an equal set, else stays null and
alone.  Rows that share a doc_id are one document, linked by any of its texts; rows that repeat doc_id and text are compared once (``_once``).  Further columns
are not read by ``components`` and pass through ``keep_rows``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import free_mark, group_values, map_batches, one_row_each, table
from tracefold.llm.spans import hashes, mix, text_bytes, words
from tracefold.session import write_through

SHINGLE = 4
#: Words of the longest shingle that can be asked for.
MOST = 16
LIMIT = 80  # per cent
REGISTERS, ROWS = 256, 6
BANDS = REGISTERS // ROWS
B, RATE = 1.001, 20.0
BLOCK = 128
SCREEN = 0.8 - 5 * (0.8 * 0.2 / REGISTERS) ** 0.5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE = np.random.default_rng(7).integers(1, 2**63, MOST, dtype=np.uint64) | np.uint64(1)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted."""
    if not 1 <= size <= MOST:
        raise ValueError(f"shingles have 1 to {MOST} words")
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    starts, ends, before = words(data, offsets)
    h = hashes(data, starts, ends)
    n = np.diff(before)
    row = np.repeat(np.arange(len(n)), n)
    # a text with fewer words has one shingle, of the words it has
    first = (np.arange(len(h)) + size <= before[1:][row]) | ((np.arange(len(h)) == before[:-1][row]) & (n[row] < size))
    at = np.flatnonzero(first)
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = at + k < before[1:][row[at]]
        total += np.where(inside, mix(h[np.minimum(at + k, len(h) - 1)] * _PLACE[k]), np.uint64(k))
    row, total = row[at], mix(total)
    order = np.lexsort((total, row))
    row, total = row[order], total[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (total[1:] != total[:-1])
    return row[new], total[new]


def registers(row: np.ndarray, element: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of ``n`` sets given as (set, element)."""
    least = np.full(n * m, np.inf)
    time, step, draws = np.zeros(len(row)), 0, 1
    while len(row):
        # the next arrivals of each stream: rate m, dealt to registers at random
        k = np.arange(step, step + draws, dtype=np.uint64)
        bits = mix(element[:, None] + k * np.uint64(0x9E3779B97F4A7C15))
        at = time[:, None] + np.cumsum(-np.log1p(-((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53)), axis=1) / m
        register = (mix(bits ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(least, (row[:, None] * m + register).ravel(), at.ravel())
        time = at[:, -1]
        more = time < least.reshape(n, m).max(axis=1)[row]  # later arrivals change nothing
        row, element, time, step = row[more], element[more], time[more], step + draws
        draws = min(64, draws * 2) if step > 2 else 1
    with np.errstate(divide="ignore"):
        scale = np.floor(1 - np.log(least / RATE) / np.log(B))
    return np.clip(np.nan_to_num(scale, neginf=0), 0, 65535).astype(np.uint16).reshape(n, m)


def likeliest(n_u: np.ndarray, n_v: np.ndarray, greater: np.ndarray, less: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Jaccard similarity of greatest likelihood, from set sizes and the numbers of registers that are greater and less in the first."""
    u = n_u / (n_u + n_v)
    v, equal = 1 - u, m - greater - less

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (B - 1) / B) / np.log(B)

    def value(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return greater * np.log(up + tiny) + less * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(28):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = value(a) < value(b)
        low, high = np.where(left, a, low), np.where(left, high, b)
    return (low + high) / 2


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, a 128-bit identity of the set (h1, h2) and its registers."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            row, h = shingles(batch.column(1), size)
            n = batch.num_rows
            count = np.bincount(row, minlength=n)
            sums = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum([mix(h), mix(h ^ np.uint64(0x94D049BB133111EB))], axis=1, dtype=np.uint64)], axis=1)
            end = np.cumsum(count)
            one, two = (sums[:, end] - sums[:, end - count]).view(np.int64)
            kept = registers(row, h, n)
            whole, wide = kept.tobytes(), 2 * REGISTERS
            sketch = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * wide).astype(np.int32)), pa.py_buffer(whole)])
            return {"doc_id": batch.column(0), "n_shingles": pa.array(count), "h1": pa.array(one), "h2": pa.array(two), "sketch": sketch}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, n_shingles long, h1 long, h2 long, sketch binary")


def screen(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that are similar by the likelihood estimate."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"k_{s}"))

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            a, b, n_a, n_b = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("a", "b", "n_a", "n_b"))
            k_a, k_b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("k_a", "k_b"))
            j = likeliest(n_a, n_b, (k_a > k_b).sum(axis=1), (k_a < k_b).sum(axis=1))
            return {"a": pa.array(a[j >= SCREEN]), "b": pa.array(b[j >= SCREEN])}

        return step

    # sets whose sizes differ too much can't be similar
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= LIMIT * F.greatest("n_a", "n_b"))
    return map_batches(sized.select("a", "b", "n_a", "n_b", "k_a", "k_b"), make, "a long, b long").distinct()


def _once(rows: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (with doc_id) without repeats in ``keys``; only rows whose id is one of ``repeated`` are moved for that."""
    return rows.join(repeated, "doc_id", "left_anti").unionByName(rows.join(repeated, "doc_id", "left_semi").dropDuplicates(keys))


def _texts(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id and text, each pair once."""
    return _once(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), repeated, ["doc_id", "text"])


def verify(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Pairs whose full sets reach the limit.  ``texts``: doc_id and text, each pair once."""
    text = lambda s: texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"t_{s}"))

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            n = batch.num_rows
            a, b, t_a, t_b = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "t_a", "t_b"))
            row, h = shingles(pa.concat_arrays([t_a, t_b]), size)
            sizes = np.bincount(row, minlength=2 * n)
            order = np.lexsort((h, row % n))
            pair, h = row[order] % n, h[order]
            both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (h[1:] == h[:-1])], minlength=n)
            link = 100 * both >= LIMIT * (sizes[:n] + sizes[n:] - both)
            return {"a": a.filter(pa.array(link)), "b": b.filter(pa.array(link))}

        return step

    both = pairs.join(text("a"), "a").join(text("b"), "b")
    return map_batches(both.select("a", "b", "t_a", "t_b"), make, "a long, b long").distinct()


def connect(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), for nodes with a link.  Stars are contracted until nothing changes."""
    edges = write_through(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    mark = None
    while True:
        # large stars: neighbours above a node move to the smallest of its neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small stars: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        edges = write_through(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now


def _groups(named: DataFrame) -> DataFrame:
    """(group, node, component, out) in which to look for further links: every pair of members of one bucket in different components shares a group, where one of
    the two has ``out``.  Buckets that overlap are taken together if that makes fewer pairs than the buckets on their own."""
    first = named.where("node = first").select("bucket", F.col("component").alias("_c"))
    marked = named.join(first, "bucket").withColumn("out", F.col("component") != F.col("_c")).drop("_c")
    size = marked.groupBy("bucket").agg((F.count("*") * F.sum(F.col("out").cast("long"))).alias("_pairs")).where("_pairs > 0")
    open_ = write_through(marked.join(size, "bucket"), "open")
    family = connect(open_.where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    of_bucket = family.select(F.col("node").alias("_f"), F.col("component").alias("family"))
    of_first = open_.select("bucket", "first").distinct().join(of_bucket, F.col("first") == F.col("_f"), "left").select("bucket", F.coalesce("family", "first").alias("family"))
    together = open_.join(of_first, "bucket")
    whole = together.select("family", "node", "component").distinct()
    sizes = whole.groupBy("family", "component").agg(F.count("*").alias("_n"))
    main = sizes.groupBy("family").agg(F.sum("_n").alias("_all"), F.max("_n").alias("_most"), F.max_by("component", F.struct("_n", "component")).alias("_main"))
    cost = together.select("family", "bucket", "_pairs").distinct().groupBy("family").agg(F.sum("_pairs").alias("_apart"))
    choice = main.join(cost, "family").withColumn("_joint", F.col("_all") * (F.col("_all") - F.col("_most")) <= F.col("_apart")).select("family", "_main", "_joint")
    choice = write_through(choice, "families")
    joint = whole.join(choice.where("_joint"), "family").select(F.xxhash64(F.lit("f"), "family").alias("group"), "node", "component", (F.col("component") != F.col("_main")).alias("out"))
    apart = together.join(choice.where("NOT _joint"), "family").select(F.xxhash64(F.lit("b"), "bucket").alias("group"), "node", "component", "out")
    return joint.union(apart)


def remaining(named: DataFrame, nodes: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Links between members of a bucket in different components, in blocks of at most about ``BLOCK`` members against as many others."""
    groups = write_through(_groups(named), "groups")
    needed = groups.select(F.col("node").alias("doc_id")).distinct()

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            row, h = shingles(batch.column(1), size)
            place = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]) * 8
            return {"node": batch.column(0), "elements": pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(place.astype(np.int32)), pa.py_buffer(h.tobytes())])}

        return step

    sets = map_batches(texts.join(needed, "doc_id", "left_semi"), make, "node long, elements binary").join(nodes.select("node", "sketch"), "node")
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("_ys"), F.ceil(F.sum(F.col("out").cast("long")) / BLOCK).alias("_xs")).where("_xs > 0")
    full = groups.join(sizes, "group").join(sets, "node")
    mine = F.xxhash64("node")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    x = full.where("out").select("group", F.pmod(mine, F.col("_xs")).alias("i"), upto("_ys").alias("j"), F.lit(True).alias("x"), "node", "component", "sketch", "elements")
    y = full.select("group", upto("_xs").alias("i"), F.pmod(mine, F.col("_ys")).alias("j"), F.lit(False).alias("x"), "node", "component", "sketch", "elements")

    def block(rows: pa.Table) -> pa.Table:
        is_x, node, component = (np.asarray(rows[c].combine_chunks()) for c in ("x", "node", "component"))
        k = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        sets = [np.frombuffer(e, np.uint64) for e in rows["elements"].to_pylist()]
        n = np.array([len(e) for e in sets])
        xs, ys, found = np.flatnonzero(is_x), np.flatnonzero(~is_x), []
        i, j = (v.ravel() for v in np.meshgrid(xs, ys, indexing="ij"))
        open_ = (component[i] != component[j]) & (100 * np.minimum(n[i], n[j]) >= LIMIT * np.maximum(n[i], n[j]))
        i, j = i[open_], j[open_]
        counts = [np.concatenate([np.zeros(0, int), *[op(k[x], k[j[i == x]]).sum(axis=1) for x in xs.tolist()]]) for op in (np.greater, np.less)]
        near = likeliest(n[i], n[j], *counts) >= SCREEN
        for one, other in zip(i[near].tolist(), j[near].tolist(), strict=True):
            both = len(np.intersect1d(sets[one], sets[other], assume_unique=True))
            if 100 * both >= LIMIT * (n[one] + n[other] - both):
                found.append(sorted((int(node[one]), int(node[other]))))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return x.union(y).groupBy("group", "i", "j").applyInArrow(block, "a long, b long").distinct()


def components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    sketched = write_through(sketches(docs, size), "sketches")
    keys = ["n_shingles", "h1", "h2"]
    rows = group_values(sketched.drop("sketch"), keys, {"least": F.min("doc_id")}, {"node": F.min("_least")}, ["doc_id"])
    rows = write_through(rows, "classes")
    repeated = write_through(rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    first = rows.where("n_shingles > 0 AND doc_id = node").select("doc_id", *keys).distinct()
    nodes = write_through(_once(sketched.join(first, ["doc_id", *keys], "left_semi"), repeated, ["doc_id", *keys]).withColumnRenamed("doc_id", "node"), "nodes")
    texts = _texts(docs, repeated)

    band = lambda i: F.xxhash64(i, F.substring("sketch", i * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    bands = nodes.select("node", F.explode(F.array(*[band(F.lit(i)) for i in range(BANDS)])).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = write_through(bands.join(shared, "bucket"), "members")

    pairs = members.where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = write_through(verify(screen(pairs, nodes), texts, size), "verified")
    known = connect(links)
    named = members.join(known, "node", "left").select("bucket", "node", "first", F.coalesce("component", "node").alias("component"))
    more = write_through(remaining(write_through(named, "named"), nodes, texts, size), "verified")
    if more.limit(1).count():
        known = connect(links.union(more))

    known = known.withColumnRenamed("node", "_n")
    out = rows.join(known, rows["node"] == F.col("_n"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_rows(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of each group of linked documents, with all columns."""
    mark = free_mark(docs)
    node, ties = f"{mark}node", f"{mark}ties"
    kept = components(docs, size).where("kept").groupBy(F.col("doc_id").alias(node)).agg(F.count("*").alias(ties))
    known = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col(node)))
    # without an id each row that stays is a document of its own
    named, single = known.where(F.col(node).isNotNull()), known.where(F.col(node).isNull())
    return one_row_each(named, [node], ties).unionByName(single).select(*docs.columns)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


QUERIES = {"op1_minhash": op1_minhash}
#: DuckDB cannot join the sets of whole tables in time: tests compare with brute force.
SQL: dict[str, str] = {}
