"""Matching cases against the model: joins on prefix identities.

The model side of every join has one row per node, so a prefix shared by a third of all cases is skew on one side only:
AQE splits it, or broadcasts the model if it is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.hotkeys import running
from tracefold.operators.model import BY_TIME, NODE, PARENT, order_in_case, step_hash, with_prefix
from tracefold.session import write_through


def case_prefixes(log: DataFrame, order: list[str] = BY_TIME, limit: int | None = None) -> DataFrame:
    """Each event with the identity of the case prefix that ends at it."""
    return with_prefix(order_in_case(log, order, limit), order, limit).withColumnRenamed("pos", "level")


def replay(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each event with the model node its case prefix leads to (``first_trace`` is null if none does)."""
    model = nodes.select(*NODE, F.col("symbol").alias("activity"), "p_z1", "p_z2", "first_trace", "is_end", "min_to_end")
    return prefixes.join(model, [*NODE, "activity", "p_z1", "p_z2"], "left")


def longest_prefix(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per case: events, length of the longest prefix that is a path from the root, and whether it ends a trace.

    ``matched`` is null when not even the first event matches.  Prefixes of nodes are nodes, so the matched events of a
    case are its first ones.
    """
    hit = F.col("first_trace").isNotNull()
    level = F.when(hit, F.col("level"))
    return replay(prefixes, nodes).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max(level).alias("matched"),
        F.max_by("first_trace", level).alias("first_trace"),
        F.max_by("is_end", level).alias("at_end"),
    )


def child(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """Child of the node in (level, z1, z2) with label ``activity``; no child leaves ``child_trace`` null."""
    kids = nodes.select(
        F.col("p_level").alias("level"),
        F.col("p_z1").alias("z1"),
        F.col("p_z2").alias("z2"),
        F.col("symbol").alias("activity"),
        F.col("first_trace").alias("child_trace"),
        F.col("level").alias("child_level"),
    )
    return df.join(kids, [*NODE, "activity"], "left")


def complete_match(pairs: DataFrame, nodes: DataFrame, seq: str = "seq") -> DataFrame:
    """Node reached by walking the whole sequence from a start node; pairs that leave the model keep a null.

    A sequence extends a prefix by one hash per step, so the target identity is computed, not searched.
    """
    hits = nodes.select(
        F.col("level").alias("m_level"), F.col("z1").alias("m_z1"), F.col("z2").alias("m_z2"), F.col("first_trace").alias("match_trace")
    )
    return pairs.select("*", *walked(F.col(seq))).join(hits, ["m_level", "m_z1", "m_z2"], "left").drop("m_z1", "m_z2")


def walked(seq: Column, start: list[Column] | None = None, names: tuple = ("m_level", "m_z1", "m_z2")) -> list[Column]:
    """Identity of the prefix that a sequence makes of a start (default: the columns of NODE)."""
    level, *lanes = start or [F.col(c) for c in NODE]
    target = [(level + F.size(seq)).alias(names[0])]
    for lane, at, name in zip(NODE[1:], lanes, names[1:]):
        steps = F.transform(seq, lambda a, i: step_hash(lane, level + i + 1, a))  # noqa: B023
        target.append(F.aggregate(steps, at, lambda acc, h: acc.bitwiseXOR(h)).alias(name))
    return target


def match_in_hops(starts: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """Nodes with label ``evt`` one to ``hops`` levels below each start node.

    ``starts`` has the node identity and any other columns; one join with the nodes per level, written before the next level reads it.
    """
    kids = nodes.select(*[F.col(p).alias(f"_{n}") for p, n in zip(PARENT, NODE)], *[F.col(n).alias(f"k_{n}") for n in NODE],
                        "symbol", F.col("first_trace").alias("hit_trace"))
    keep = starts.columns
    at = starts.select("*", *[F.col(n).alias(f"_{n}") for n in NODE])
    found = []
    for hop in range(1, hops + 1):
        step = at.join(kids, ["_level", "_z1", "_z2"]).drop("_level", "_z1", "_z2")
        step = write_through(step, "hop") if hop < hops else step
        found.append(step.filter("symbol = evt").select(*keep, F.lit(hop).alias("hop"), "hit_trace", F.col("k_level").alias("hit_level")))
        at = step.select(*keep, *[F.col(f"k_{n}").alias(f"_{n}") for n in NODE])
    return reduce(DataFrame.unionByName, found)


def next_on_shortest(nodes: DataFrame, with_root: DataFrame) -> DataFrame:
    """Per node the child on the shortest way to an end: an end child wins, else the child that is strictly nearer."""
    best = F.min_by(
        F.struct("symbol", "is_end", "min_to_end"), F.struct(~F.col("is_end"), "min_to_end", "symbol")
    ).alias("kid")
    kids = nodes.groupBy(*PARENT).agg(best).toDF(*NODE, "kid")
    better = F.col("kid.is_end") | (F.col("kid.min_to_end") < F.col("min_to_end"))
    return with_root.join(kids, NODE, "left").withColumn("next_symbol", F.when(better, F.col("kid.symbol"))).drop("kid")


def closest_child(nodes: DataFrame, length: int | Column) -> DataFrame:
    """Per inner node the child whose shortest way to an end is nearest to ``length``; ties by label."""
    gap = F.abs(F.col("min_to_end") - length)
    return nodes.groupBy(*PARENT).agg(
        F.min_by("symbol", F.struct(gap, "symbol")).alias("symbol"), F.min(gap).alias("gap")
    ).toDF(*NODE, "symbol", "gap")


def bag_lanes(activity: str) -> list[Column]:
    """Two summands per activity; their sums name a bag of activities whatever its order."""
    return [F.pmod(F.xxhash64(F.lit(s), F.col(activity)), F.lit(2**31)).cast("bigint").alias(n) for s, n in (("B", "b1"), ("C", "b2"))]


def node_bags(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The trace rows with the running bag sums of their prefix."""
    rows = rows.select("*", *bag_lanes("activity"))
    return running(rows, ["case_id"], ["level"], {"s1": ("sum", F.col("b1")), "s2": ("sum", F.col("b2"))}, limit)


def match_any_order(groups: DataFrame, rows: DataFrame, nodes: DataFrame, limit: int | None = None, events: DataFrame | None = None) -> DataFrame:
    """Nodes that some permutation of a group of activities reaches from a start node.

    ``groups``: ``group_id``, the start node's (level, z1, z2) - (0, 0, 0) is the root -, the group's size ``n`` and bag sums
    ``g1, g2``.  The bag of the path from the start to a node is the difference of two prefix sums, so permutations are
    never enumerated: groups at the root meet the nodes of their depth and bag sum; the others meet, by the start's identity too, pairs of a node and its ancestor
    as many levels above as some group there is large.  Sums of different bags may agree by chance: with
    ``events`` (``group_id``, ``activity``, one row per member) the two bags are compared, count by count (``_same_bag``).
    """
    bags = write_through(node_bags(rows, limit).select(*NODE, "trace_id", "s1", "s2"), "bags")
    at_nodes = nodes.select(*NODE, "first_trace").join(bags.withColumnRenamed("trace_id", "first_trace"), [*NODE, "first_trace"])
    hit = at_nodes.select("level", "s1", "s2", "first_trace", F.col("z1").alias("hit_z1"), F.col("z2").alias("hit_z2"))
    start = [F.col(c).alias(f"s_{c}") for c in NODE]
    kept = ["group_id", "s_level", F.col("level").alias("hit_level"), "first_trace", "hit_z1", "hit_z2"]
    from_root = groups.filter("level = 0").select("group_id", F.col("level").alias("s_level"), F.col("n").alias("level"), F.col("g1").alias("s1"), F.col("g2").alias("s2"))
    from_root = from_root.join(hit, ["level", "s1", "s2"]).select(*kept)
    inner = groups.filter("level > 0").select("group_id", *start, "n", "g1", "g2")
    sizes = inner.select("s_level", "n", (F.col("s_level") + F.col("n")).alias("level")).distinct()
    above = bags.select(F.col("trace_id").alias("first_trace"), *start, F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    pairs = hit.join(sizes, "level").join(above, ["first_trace", "s_level"]).withColumns({"g1": F.col("s1") - F.col("a1"), "g2": F.col("s2") - F.col("a2")})
    inner = inner.join(pairs.drop("s1", "s2", "a1", "a2"), ["s_level", "s_z1", "s_z2", "n", "g1", "g2"]).select(*kept)
    out = from_root.unionByName(inner)
    return out if events is None else _same_bag(out, rows, events)


def _same_bag(hits: DataFrame, rows: DataFrame, events: DataFrame) -> DataFrame:
    """The hits whose path below the start has each activity as often as the group has."""
    key = ["group_id", "s_level", "hit_level", "first_trace"]
    steps = hits.select(*key, F.explode(F.sequence(F.col("s_level") + 1, F.col("hit_level"))).alias("level"))  # as many as the group has events
    path = steps.join(rows.select(F.col("trace_id").alias("first_trace"), "level", "activity"), ["first_trace", "level"]).groupBy(*key, "activity").agg(F.count(F.lit(1)).alias("_on_path"))
    own = events.groupBy("group_id", "activity").agg(F.count(F.lit(1)).alias("_in_group"))
    agree = path.join(own, ["group_id", "activity"]).where("_on_path = _in_group").groupBy(*key).agg(F.sum("_on_path").alias("_n"))
    # path and group have equally many events
    return hits.join(agree.where(F.col("_n") == F.col("hit_level") - F.col("s_level")).select(*key), key, "left_semi")


def known_cases(log: DataFrame, requested: DataFrame) -> DataFrame:
    """The requested cases that have events."""
    return requested.join(log.select("case_id"), "case_id", "left_semi")


def unseen(log: DataFrame, alphabet: DataFrame) -> DataFrame:
    """The events whose activity is not in the alphabet."""
    # once each: a join by activity must not carry the rows of a frequent one into one task
    return log.join(alphabet.select("activity").distinct(), "activity", "left_anti")


def unknown_case_cost(log: DataFrame, nodes: DataFrame, requested: DataFrame) -> DataFrame:
    """Cases without any event: model moves along the shortest trace (one value for all)."""
    cost = nodes.filter("is_end").agg(F.min("level").alias("cost"))
    return requested.join(log.select("case_id"), "case_id", "left_anti").crossJoin(F.broadcast(cost))  # cost is one row


def best_leaf(states: DataFrame, model) -> DataFrame:
    """Cheapest end strictly below a state: the fewest log and model moves between its open events and the rest of a trace; ties go to the nearer end.

    ``states``: ``state_id``, the node by identity (``level``, ``z1``, ``z2``) or by name (``first_trace``, ``level``), ``postfix`` ARRAY<STRING> (the open events),
    ``base_cost`` and ``cost_limit``.  Only results below the limit are kept.

    The search goes down the tree one level per round, all states at once: a frontier row is a state and a node with one row of the insert/delete distance
    (``_next_row``), and meets the children of its node in a join.  Rows that can't stay below the limit, or below the best end found so far, are left behind.  Equal
    (node, open events, limit) are searched once.  A round is written before the next one starts.
    """
    if "z1" not in states.columns:
        steps = model.rows.select(F.col("trace_id").alias("first_trace"), "level", "z1", "z2")
        states = states.join(steps, ["first_trace", "level"])
    states = states.select("state_id", *NODE, "postfix", "base_cost", (F.col("cost_limit") - F.col("base_cost")).alias("room"))
    search = [*NODE, "postfix", "room"]
    asked = write_through(states.where("room > 0").select(*search).distinct().withColumn("ask", F.monotonically_increasing_id()), "asked")
    kids = model.nodes.select(*[F.col(p).alias(n) for p, n in zip(PARENT, NODE)], *[F.col(n).alias(f"k_{n}") for n in NODE], "symbol", "min_to_end")
    front = asked.select("ask", *search, F.transform(F.sequence(F.lit(0), F.size("postfix")), lambda j: j).alias("above"))
    rounds = []
    while True:
        step = front.join(kids, NODE).withColumn("row", _next_row(F.col("above"), F.col("postfix"), F.col("symbol")))
        # at least min_to_end more nodes follow; those beyond the events left are model moves
        more = F.transform("row", lambda r, j: r + F.greatest(F.lit(0), F.col("min_to_end") - F.size("postfix") + j))
        step = step.where(F.array_min(more) < F.col("room"))
        step = write_through(step.select("ask", *[F.col(f"k_{n}").alias(n) for n in NODE], "postfix", "room", F.col("row").alias("above"), (F.col("min_to_end") == 0).alias("end")), "front")
        if step.isEmpty():
            break
        cost = F.element_at("above", -1).cast("int")
        ends = step.where(F.col("end") & (cost < F.col("room"))).select("ask", cost.alias("cost"), F.col("level").cast("int").alias("leaf_level"))
        rounds.append(ends)
        # rows of later rounds come from these, so what earlier rounds found is in their room already
        best = ends.groupBy(F.col("ask").alias("_ask")).agg(F.min("cost").alias("_best"))
        front = step.drop("end").join(best, F.col("ask") == F.col("_ask"), "left").withColumn("room", F.least("room", F.coalesce("_best", "room"))).drop("_ask", "_best")
    found = reduce(DataFrame.union, rounds) if rounds else asked.limit(0).select("ask", F.lit(0).alias("cost"), F.lit(0).alias("leaf_level"))
    found = found.groupBy("ask").agg(F.min(F.struct("cost", "leaf_level")).alias("best"))
    leaves = asked.join(found, "ask").select(*search, "best")
    met = states.join(leaves, search)
    return met.select("state_id", (F.col("base_cost") + F.col("best.cost")).cast("int").alias("cost"), F.col("best.leaf_level").alias("leaf_level"))


def _next_row(above: Column, events: Column, symbol: Column) -> Column:
    """The next row of the insert/delete distance: entry j is the cost of the first j events against the way down to a node with ``symbol``."""
    step = F.transform(above, lambda r, j: F.when((j > 0) & (F.get(events, j - 1) == symbol), F.get(above, j - 1)).otherwise(r + 1) - j)
    least = lambda so_far, x: F.array_append(so_far, F.coalesce(F.least(F.element_at(so_far, -1), x), x))
    first = F.array(F.get(step, F.lit(0)))
    runs = F.aggregate(F.slice(step, F.lit(2), F.greatest(F.size(step) - 1, F.lit(0))), first, least)  # as long as the retention
    return F.transform(runs, lambda x, j: x + j)
