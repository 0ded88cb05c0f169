"""The model: example traces as a prefix tree, built with aggregations only.

A node of the tree is a prefix of some trace.  It is identified by ``(level, z1, z2)``: two 64-bit values that combine
one hash per (position, activity) of the prefix with exclusive or.  Every event row therefore *is* the prefix that ends
at it, the tree is one ``groupBy`` over the event rows, and data stays linear in the log (prefix arrays would be
quadratic).  ``node_table`` fails if two different prefixes ever share an identity, see ``_same``.

``trace_id`` is the smallest ``arrival_seq`` of the trace: unique, and in the order in which traces were first seen.
``(first_trace, level)`` names a node without hashes: the first trace that runs through it and the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.operators.hotkeys import HOT_ROWS, position, running, with_totals

NODE = ["level", "z1", "z2"]
PARENT = ["p_level", "p_z1", "p_z2"]
_SEEDS = {"z1": "L", "z2": "R"}
MAX_PATTERN = 10


def step_hash(lane: str, pos: Column, activity: Column) -> Column:
    return F.xxhash64(F.lit(_SEEDS[lane]), pos.cast("bigint"), activity)


BY_TIME = ["event_time", "arrival_seq"]
BY_ARRIVAL = ["arrival_seq"]


def order_in_case(log: DataFrame, order: list[str] = BY_TIME, limit: int | None = None) -> DataFrame:
    """Number the events of each case: adds ``pos``.

    Default is event-time order with delivery order on equal times; files that are already models (XES) use BY_ARRIVAL.
    """
    return position(log, ["case_id"], order, "pos", limit)


def with_prefix(ordered: DataFrame, order: list[str] = BY_TIME, limit: int | None = None) -> DataFrame:
    """Add the prefix identity (z1, z2) of each event and that of its parent prefix.

    ``order`` must be the one that gave ``pos``; the window then reuses its sort.
    """
    lanes = {z: ("xor", step_hash(z, F.col("pos"), F.col("activity"))) for z in _SEEDS}
    out = running(ordered, ["case_id"], order, lanes, limit)
    for z in _SEEDS:
        out = out.withColumn(f"p_{z}", F.col(z).bitwiseXOR(step_hash(z, F.col("pos"), F.col("activity"))))
    return out


def trace_rows(log: DataFrame, order: list[str] = BY_TIME, limit: int | None = None) -> DataFrame:
    """Traces in row form: (trace_id, case_id, level, activity, z1, z2, p_z1, p_z2, trace_len).

    Cases without events have no row, so empty traces never enter the model.
    """
    rows = with_prefix(order_in_case(log, order, limit), order, limit)
    rows = with_totals(rows, ["case_id"], {"trace_id": F.min("arrival_seq"), "trace_len": F.count(F.lit(1))})
    return rows.select("trace_id", "case_id", F.col("pos").alias("level"), "activity", "z1", "z2", "p_z1", "p_z2", "trace_len")


def traces(rows: DataFrame) -> DataFrame:
    """One row per trace with its text; for logs whose single traces fit a row."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("level", "activity"))), lambda s: s["activity"])
    return rows.groupBy("trace_id", "case_id").agg(steps.alias("trace"))


def trace_index(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Dense 1-based index of the traces in the order they were first seen."""
    first = log.groupBy("case_id").agg(F.min("arrival_seq").alias("trace_id"))
    return position(first, [], ["trace_id"], "trace_idx", limit)


def variants(rows: DataFrame) -> DataFrame:
    """Distinct traces: end node, number of traces, first trace, length."""
    ends = rows.filter("level = trace_len")
    return ends.groupBy(*NODE).agg(F.min("trace_id").alias("first_trace"), F.count(F.lit(1)).alias("n_traces"))


def _same(col: str) -> Column:
    """The common value of a group; fails on a hash collision.

    Suppose two different prefixes shared an identity, and take the shortest such pair.  Their parents are equal or have
    different identities, so the two differ in their last activity or in their parent identity: this check sees it.
    """
    message = F.lit("two prefixes share one identity; change the hash seeds")
    return F.when(F.min(col) == F.max(col), F.min(col)).otherwise(F.raise_error(message))


def node_table(rows: DataFrame) -> DataFrame:
    """The nodes below the root, one row each."""
    end = F.col("trace_len") == F.col("level")
    rest = F.col("trace_len") - F.col("level")
    return rows.groupBy(*NODE).agg(
        _same("activity").alias("symbol"),
        (F.col("level") - 1).alias("p_level"),
        _same("p_z1").alias("p_z1"),
        _same("p_z2").alias("p_z2"),
        F.min("trace_id").alias("first_trace"),
        F.count(F.lit(1)).alias("n_traces"),
        F.count(F.when(end, 1)).alias("n_ends"),
        F.min(F.when(end, F.col("trace_id"))).alias("first_end"),
        F.bool_or(end).alias("is_end"),
        F.min(rest).alias("min_to_end"),
        F.max(rest).alias("max_to_end"),
    )


def root_table(rows: DataFrame) -> DataFrame:
    """The root as a row of the node table's identity and path-length columns."""
    return rows.filter("level = 1").agg(
        F.lit(0).cast("bigint").alias("level"),
        F.lit(0).cast("bigint").alias("z1"),
        F.lit(0).cast("bigint").alias("z2"),
        F.min("trace_id").alias("first_trace"),
        F.count(F.lit(1)).alias("n_traces"),
        F.lit(False).alias("is_end"),
        F.min("trace_len").alias("min_to_end"),
        F.max("trace_len").alias("max_to_end"),
    )


def with_root(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.unionByName(root_table(rows), allowMissingColumns=True)


def linked_traces(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, trace) pairs: which traces run through a node.  The root's pairs are all traces."""
    below = rows.join(nodes.select(*NODE, "first_trace"), NODE).select("first_trace", "level", "trace_id")
    root = rows.filter("level = 1").select(
        F.lit(None).cast("bigint").alias("first_trace"), F.lit(0).cast("bigint").alias("level"), "trace_id"
    )
    return below.unionByName(root)


def children(nodes: DataFrame) -> DataFrame:
    """Per inner node: number of children and their labels (at most the alphabet) in order."""
    return nodes.groupBy(*PARENT).agg(
        F.count(F.lit(1)).alias("n_children"), F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("labels")
    )


def prefix_text(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``A->B->C`` per node, cut from the first trace through it.  The text itself is as long as the node is deep."""
    text = traces(rows).select(F.col("trace_id").alias("first_trace"), "trace")
    return nodes.join(text, "first_trace").withColumn(
        "prefix", F.array_join(F.slice("trace", F.lit(1), F.col("level").cast("int")), "->")
    ).drop("trace")


def leaf_visits(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per time a trace walks over a node that is an end at that moment."""
    ends = nodes.filter("is_end").select(*NODE, "first_end")
    return rows.join(ends, NODE).filter("trace_id >= first_end").select("trace_id", *NODE)


def model_stats(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: average, longest, shortest trace length, node and event counts, first trace among the shortest."""
    visits = leaf_visits(rows, nodes).agg(
        F.count(F.lit(1)).alias("leaf_visits"), F.floor(F.sum("level") / F.count(F.lit(1))).alias("avg_len")
    )
    shape = nodes.agg(
        F.max(F.when(F.col("is_end"), F.col("level"))).alias("max_len"),
        F.min(F.when(F.col("is_end"), F.col("level"))).alias("min_len"),
        F.count(F.lit(1)).alias("n_nodes"),
        F.sum("n_traces").alias("n_events"),
        F.min_by("first_end", F.when(F.col("is_end"), F.struct("level", "first_end"))).alias("shortest_trace"),
    )
    return visits.crossJoin(shape)  # one row each


def ngrams(log: DataFrame, max_len: int = MAX_PATTERN, order: list[str] = BY_TIME, limit: int | None = None) -> DataFrame:
    """Contiguous activity patterns of length 2..max_len with their number of occurrences; max_len below 2 gives none."""
    grams = windows_ahead(order_in_case(log, order, limit), max(max_len, 1), limit)
    lengths = F.sequence(F.lit(2), F.size("ahead"))
    grams = grams.filter(F.size("ahead") >= 2).select("ahead", F.explode(lengths).alias("n"))
    return grams.select(F.slice("ahead", F.lit(1), F.col("n")).alias("pattern")).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("freq")
    )


def windows_ahead(ordered: DataFrame, max_len: int, limit: int | None = None) -> DataFrame:
    """Each event with the next ``max_len - 1`` activities of its case.

    A case is cut into blocks of ``span`` positions; the first rows of a block are also given to the block before it,
    so that no window has to hold a whole hot case.
    """
    span = max(limit or HOT_ROWS, max_len)
    block = F.floor((F.col("pos") - 1) / span)
    into = (F.col("pos") - 1) % span < max_len - 1
    homes = F.when((block > 0) & into, F.array(block, block - 1)).otherwise(F.array(block))
    spread = ordered.select("case_id", "pos", "activity", block.alias("home"), F.explode(homes).alias("block"))
    frame = Window.partitionBy("case_id", "block").orderBy("pos").rowsBetween(0, max_len - 1)
    ahead = spread.withColumn("ahead", F.collect_list("activity").over(frame))
    return ahead.filter("home = block").select("case_id", "pos", "ahead")


def pattern_rank(patterns: DataFrame, limit: int | None = None) -> DataFrame:
    """Patterns in order of falling frequency; ties in the order of the pattern."""
    return patterns.orderBy(F.desc("freq"), "pattern")


def leaves_below(rows: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """End nodes strictly below each start node and not deeper than its ``max_level``.

    ``starts`` has the node identity, ``start_id`` and ``max_level``.  The traces in row form already list all
    (ancestor, trace) pairs, so this is one join on the start node and one on the end node.
    """
    ends = nodes.filter("is_end").select(
        F.col("first_end").alias("trace_id"), F.col("level").alias("leaf_level"), F.col("z1").alias("leaf_z1"), F.col("z2").alias("leaf_z2")
    )
    paths = rows.select(*NODE, "trace_id").join(ends, "trace_id").filter("leaf_level > level")
    return paths.join(starts, NODE).filter("leaf_level <= max_level").select(
        "start_id", F.col("trace_id").alias("leaf_trace"), "leaf_level", "leaf_z1", "leaf_z2"
    )
