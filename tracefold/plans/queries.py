"""Registered queries: each takes (spark, sf_dir) and reads whole tables.

Nodes are reported as (first_trace, level): the first trace through the node and its depth; the root has level 0.
"""

from __future__ import annotations

import uuid
from functools import lru_cache, wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.functions import alignment as al
from tracefold.functions import labels
from tracefold.operators import alphabet as ab
from tracefold.operators import disorder, experiments, matching, ordering
from tracefold.operators import model as md
from tracefold.operators.conformance import Model, check, retained
from tracefold.params import Params
from tracefold.session import shared_dir, write_through
from tracefold.sources import messages
from tracefold.sources.tables import lineitem_counts, orders_log, table, user_day_log, user_log

QUERIES: dict = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold times without a zone
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@lru_cache(maxsize=8)
def _model(spark: SparkSession, sf_dir: str, name: str) -> Model:
    """The allowed behaviour: all cases of the log in event-time order."""
    return Model({"orders": orders_log, "users": user_log}[name](spark, sf_dir))


def _parts(spark: SparkSession, sf_dir: str, name: str):
    m = _model(spark, sf_dir, name)
    return m.rows, m.nodes


# --- scans, projections, filters -------------------------------------------------------------------------------------


def _published(log: DataFrame, setting: str) -> DataFrame:
    kept = log.filter((F.col("case_id") != labels.CONTROL_CASE) & (F.length("activity") > 0))
    return kept.select(
        labels.swap_case(setting, F.col("case_id")).alias("case_id"),
        "activity",
        labels.time_text(F.col("event_time")).alias("time_text"),
        F.lit(labels.run_label("log", Params(order="ngrams"))).alias("run_label"),
        "arrival_seq",
    )


@query
def event_log_orders(spark, sf_dir):
    return _published(orders_log(spark, sf_dir), "00")


@query
def event_log_events(spark, sf_dir):
    return _published(user_day_log(spark, sf_dir), "10")


@query
def event_log_lineitem(spark, sf_dir):
    log = lineitem_counts(spark, sf_dir)
    return log.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct("activity").alias("n_activities"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
    )


@query
def parse_messages(spark, sf_dir):
    sent = messages.as_messages(user_log(spark, sf_dir))
    return messages.parse_messages(sent).select("case_id", "activity", F.unix_millis("event_time").alias("event_ms"), "arrival_seq")


@query
def message_rejects(spark, sf_dir):
    """What a checker would refuse of a stream in which some messages are damaged, by reason."""
    sent = messages.as_messages(user_log(spark, sf_dir))
    damage = lambda n, new, old: F.when(F.col("arrival_seq") % 50 == n, new).otherwise(F.col(old))
    sent = sent.withColumn("payload", damage(1, F.regexp_replace("payload", r"\d{4}-\d\d-\d\d", "yesterday"), "payload")).withColumn("payload", damage(2, F.lit("{no json"), "payload"))
    sent = sent.withColumn("payload", damage(3, F.lit(None), "payload")).withColumn("topic", damage(4, F.lit("short"), "topic"))
    sent = sent.withColumn("topic", damage(5, F.concat_ws("/", F.lit("stream"), F.element_at(F.split("topic", "/"), 2), F.lit("")), "topic"))
    bad = messages.rejected(messages.parse_messages(sent))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n_messages"), F.min("arrival_seq").alias("first_seq"), F.max("arrival_seq").alias("last_seq"))


@query
def alphabet_encode(spark, sf_dir):
    log = user_day_log(spark, sf_dir)
    return ab.encode(log, ab.alphabet(log)).select("case_id", "arrival_seq", "activity", "symbol")


@query
def alphabet_decode(spark, sf_dir):
    log = user_day_log(spark, sf_dir)
    dim = ab.alphabet(log)
    coded = ab.encode(log, dim).select("case_id", "arrival_seq", "symbol")
    return ab.decode(coded, dim).select("arrival_seq", "symbol", "label")


@query
def alphabet_list(spark, sf_dir):
    return ab.alphabet(orders_log(spark, sf_dir)).select("activity", "symbol")


@query
def unseen_activities(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("activity"))
    return matching.unseen(orders_log(spark, sf_dir), known).select("case_id", "activity", "arrival_seq")


# --- model -----------------------------------------------------------------------------------------------------------


@query
def traces(spark, sf_dir):
    rows, _ = _parts(spark, sf_dir, "orders")
    index = md.trace_index(orders_log(spark, sf_dir)).select("trace_id", "trace_idx")
    return rows.join(index, "trace_id").select("case_id", "trace_idx", "level", "activity", "trace_len")


@query
def trace_text(spark, sf_dir):
    rows, _ = _parts(spark, sf_dir, "users")
    return md.traces(rows).select("trace_id", "case_id", F.array_join("trace", "").alias("trace"))


@query
def variants_orders(spark, sf_dir):
    rows, _ = _parts(spark, sf_dir, "orders")
    return md.variants(rows).select("first_trace", "level", "n_traces")


@query
def variants_user_days(spark, sf_dir):
    rows = md.trace_rows(user_day_log(spark, sf_dir))
    return md.variants(rows).select("first_trace", "level", "n_traces")


def _nodes(spark, sf_dir, name):
    _, nodes = _parts(spark, sf_dir, name)
    return nodes.select(
        "first_trace", "level", "symbol", "p_level", "n_traces", "n_ends", "first_end", "is_end", "min_to_end", "max_to_end"
    )


@query
def model_nodes_orders(spark, sf_dir):
    return _nodes(spark, sf_dir, "orders")


@query
def model_nodes_users(spark, sf_dir):
    return _nodes(spark, sf_dir, "users")


def _named(spark, sf_dir, name, found: DataFrame) -> DataFrame:
    """Give the nodes of ``found`` (identity columns) their names; the root has no first trace of its own."""
    rows, nodes = _parts(spark, sf_dir, name)
    return found.join(md.with_root(rows, nodes).select(*md.NODE, "first_trace"), md.NODE)


@query
def node_children(spark, sf_dir):
    _, nodes = _parts(spark, sf_dir, "orders")
    kids = md.children(nodes).toDF(*md.NODE, "n_children", "labels")
    return _named(spark, sf_dir, "orders", kids).select("first_trace", "level", "n_children", "labels")


@query
def node_prefix_text(spark, sf_dir):
    rows, nodes = _parts(spark, sf_dir, "orders")
    return md.prefix_text(rows, nodes).select("first_trace", "level", "prefix")


@query
def linked_traces(spark, sf_dir):
    rows, nodes = _parts(spark, sf_dir, "orders")
    return md.linked_traces(rows, nodes)


@query
def leaf_visits(spark, sf_dir):
    rows, nodes = _parts(spark, sf_dir, "orders")
    return md.leaf_visits(rows, nodes).select("trace_id", "level")


@query
def model_stats_orders(spark, sf_dir):
    return md.model_stats(*_parts(spark, sf_dir, "orders"))


@query
def model_stats_users(spark, sf_dir):
    return md.model_stats(*_parts(spark, sf_dir, "users"))


@query
def ngram_counts(spark, sf_dir):
    return md.ngrams(user_log(spark, sf_dir), 5).select(F.array_join("pattern", ",").alias("pattern"), "freq")


@query
def pattern_rank(spark, sf_dir):
    grams = md.ngrams(orders_log(spark, sf_dir))
    text = F.array_join("pattern", ",").alias("pattern")
    return md.pattern_rank(grams).select(text, F.size("pattern").cast("bigint").alias("n"), "freq")


@query
def leaves_below(spark, sf_dir):
    rows, nodes = _parts(spark, sf_dir, "users")
    starts = nodes.select(*md.NODE, F.struct("first_trace", "level").alias("start_id"), (F.col("level") + 40).alias("max_level"))
    found = md.leaves_below(rows, nodes, starts)
    return found.groupBy("start_id").agg(
        F.count(F.lit(1)).alias("n_leaves"), F.min("leaf_level").alias("nearest"), F.min("leaf_trace").alias("first_leaf")
    ).select("start_id.first_trace", "start_id.level", "n_leaves", "nearest", "first_leaf")


# --- matching --------------------------------------------------------------------------------------------------------


def _day_replay(spark, sf_dir):
    _, nodes = _parts(spark, sf_dir, "users")
    return matching.case_prefixes(user_day_log(spark, sf_dir)), nodes


@query
def strict_replay(spark, sf_dir):
    prefixes, nodes = _day_replay(spark, sf_dir)
    return matching.longest_prefix(prefixes, nodes).select("case_id", "n_events", "matched", "first_trace", "at_end")


@query
def strict_replay_arrival(spark, sf_dir):
    _, nodes = _parts(spark, sf_dir, "orders")
    prefixes = matching.case_prefixes(orders_log(spark, sf_dir), md.BY_ARRIVAL)
    return matching.longest_prefix(prefixes, nodes).select("case_id", "n_events", "matched", "first_trace", "at_end")


@query
def child_lookup(spark, sf_dir):
    prefixes, nodes = _day_replay(spark, sf_dir)
    asked = prefixes.select(
        "arrival_seq", "activity", (F.col("level") - 1).alias("level"), F.col("p_z1").alias("z1"), F.col("p_z2").alias("z2")
    )
    return matching.child(asked, nodes).select("arrival_seq", "level", "activity", "child_trace", "child_level")


@query
def complete_match(spark, sf_dir):
    prefixes, nodes = _day_replay(spark, sf_dir)
    ahead = md.windows_ahead(md.order_in_case(user_day_log(spark, sf_dir)), 4)
    ahead = ahead.select("case_id", F.col("pos").alias("level"), F.expr("slice(ahead, 2, 3)").alias("seq"))
    pairs = prefixes.join(ahead, ["case_id", "level"]).join(nodes.select(*md.NODE), md.NODE)
    return matching.complete_match(pairs, nodes).select(
        "arrival_seq", "level", F.array_join("seq", ",").alias("seq"), "m_level", "match_trace"
    )


@query
def match_in_hops(spark, sf_dir):
    rows, nodes = _parts(spark, sf_dir, "users")
    starts = nodes.select(*md.NODE, "first_trace", F.col("symbol").alias("evt"))
    return matching.match_in_hops(starts, nodes, 3).select("first_trace", "level", "evt", "hop", "hit_trace", "hit_level")


@query
def shortest_next(spark, sf_dir):
    rows, nodes = _parts(spark, sf_dir, "orders")
    return matching.next_on_shortest(nodes, md.with_root(rows, nodes)).select("first_trace", "level", "next_symbol")


@query
def closest_child(spark, sf_dir):
    _, nodes = _parts(spark, sf_dir, "orders")
    kids = matching.closest_child(nodes, 5)
    return _named(spark, sf_dir, "orders", kids).select("first_trace", "level", "symbol", "gap")


@query
def tie_groups(spark, sf_dir):
    return ordering.tied_events(orders_log(spark, sf_dir)).select("case_id", "ts_ms", "activity", "arrival_seq", "n_tied")


@query
def tie_order_ngrams(spark, sf_dir):
    m = _model(spark, sf_dir, "orders")
    done = ordering.as_groups(ordering.ordered_events(orders_log(spark, sf_dir), m.patterns))
    return done.select(
        "case_id", "ts_ms", "n_tied", F.array_join("delivered", ",").alias("delivered"), F.array_join("ordered", ",").alias("ordered"), "freq"
    )


@query
def match_any_order(spark, sf_dir):
    """Bags of same-day events of a customer, started at the root and at the prefix before the day."""
    rows, nodes = _parts(spark, sf_dir, "orders")
    tied = ordering.tied_events(orders_log(spark, sf_dir)).select("case_id", "arrival_seq", "ts_ms", "n_tied", "activity")
    bags = tied.select("case_id", "ts_ms", "arrival_seq", "n_tied", *matching.bag_lanes("activity"))
    places = matching.case_prefixes(orders_log(spark, sf_dir)).select("arrival_seq", "level", "p_z1", "p_z2")
    groups = bags.join(places, "arrival_seq").groupBy("case_id", "ts_ms").agg(
        F.max("n_tied").alias("n"), F.sum("b1").alias("g1"), F.sum("b2").alias("g2"),
        F.min(F.struct("level", "p_z1", "p_z2")).alias("at"),
    )
    zero = F.lit(0).cast("bigint")
    inner = groups.select(F.struct("case_id", "ts_ms").alias("group_id"), "n", "g1", "g2",
                          (F.col("at.level") - 1).alias("level"), F.col("at.p_z1").alias("z1"), F.col("at.p_z2").alias("z2"))
    root = inner.withColumns({"level": zero, "z1": zero, "z2": zero})
    events = tied.select(F.struct("case_id", "ts_ms").alias("group_id"), "activity")
    hits = matching.match_any_order(root.unionByName(inner.filter("level > 0")), rows, nodes, events=events)
    return hits.select("group_id.case_id", "group_id.ts_ms", "s_level", "hit_level", "first_trace")


@query
def known_cases(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("case_id"))
    return matching.known_cases(orders_log(spark, sf_dir), asked)


@query
def unknown_case_cost(spark, sf_dir):
    _, nodes = _parts(spark, sf_dir, "users")
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("case_id"))
    return matching.unknown_case_cost(user_log(spark, sf_dir), nodes, asked)


@query
def best_leaf_search(spark, sf_dir):
    """For every state kept after the last event of a case: the cheapest end below it, where that costs no more than the complete alignment."""
    m = _model(spark, sf_dir, "orders")
    kept = write_through(retained(orders_log(spark, sf_dir), m), "retained")
    states = kept.select(F.struct("case_id", "open_events", *md.NODE).alias("state_id"), *md.NODE, "postfix", "base_cost", (F.col("complete_cost") + 1).alias("cost_limit"))
    found = matching.best_leaf(states, m).select("state_id.*", "cost", "leaf_level")
    return _named(spark, sf_dir, "orders", found).select("case_id", "open_events", "first_trace", "level", "cost", "leaf_level")


# --- alignments ------------------------------------------------------------------------------------------------------


def _written(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    txt = F.concat(
        F.lit("Sync "), F.col("o_orderstatus"), F.lit(" >> Insertion "), F.col("o_orderpriority"),
        F.lit(">>Deletion "), F.substring("o_orderpriority", 1, 1), F.lit(" >> Other x"),
    )
    return o.select("o_orderkey", al.parse(txt).alias("moves"))


@query
def parse_alignment(spark, sf_dir):
    return _written(spark, sf_dir).select("o_orderkey", F.posexplode("moves").alias("place", "m")).select(
        "o_orderkey", F.col("place").alias("place"), "m.log", "m.model", "m.cost"
    )


@query
def alignment_algebra(spark, sf_dir):
    more = al.append(F.col("moves"), F.lit("z"), F.lit(None))
    return _written(spark, sf_dir).withColumn("moves", more).select(
        "o_orderkey",
        al.total_cost(F.col("moves")).alias("total_cost"),
        al.trace_size(F.col("moves")).alias("trace_size"),
        al.model_size(F.col("moves")).alias("model_size"),
        al.log_projection(F.col("moves")).alias("log_projection"),
        al.model_projection(F.col("moves")).alias("model_projection"),
        al.text(F.col("moves")).alias("text"),
    )


@query
def alignment_decode(spark, sf_dir):
    """Moves of encoded order states, decoded with the alphabet."""
    log = orders_log(spark, sf_dir)
    dim = ab.alphabet(log).select("activity", F.col("symbol").cast("string").alias("symbol"))
    coded = ab.encode(log, dim).select("arrival_seq", F.array(al.move(F.col("symbol"), F.col("symbol")), al.move(F.col("symbol"), F.lit(None))).alias("moves"))
    return ab.decode_moves(coded, dim, "arrival_seq").select("arrival_seq", al.text(F.col("moves")).alias("text"))


# --- disorder --------------------------------------------------------------------------------------------------------


@query
def late_flags(spark, sf_dir):
    return disorder.late_flags(orders_log(spark, sf_dir)).select("arrival_seq", "seen_ms", "late", "late_or_tied")


@query
def replay_size(spark, sf_dir):
    return disorder.replay_size(orders_log(spark, sf_dir)).select("arrival_seq", "replay")


@query
def event_time_order(spark, sf_dir):
    return md.order_in_case(orders_log(spark, sf_dir)).select("case_id", "arrival_seq", "activity", "pos")


@query
def ewma_multiplier(spark, sf_dir):
    flags = disorder.first_flags(orders_log(spark, sf_dir), "none")
    out = disorder.ewma_multiplier(flags, 0.005, 0.3)
    return out.select("arrival_seq", "flag", F.round("multiplier", 6).alias("multiplier"))


@query
def inject_disorder(spark, sf_dir):
    out = disorder.inject_disorder(user_log(spark, sf_dir))
    return out.select("setting", "case_id", "activity", F.unix_micros("event_time").alias("event_us"), "arrival_seq")


@query
def disorder_levels(spark, sf_dir):
    """Late events per swap setting."""
    moved = disorder.inject_disorder(user_log(spark, sf_dir).select("case_id", "event_time", "arrival_seq"))
    tagged = moved.withColumn("case_id", labels.swap_case(F.col("setting"), F.col("case_id")))
    tagged = write_through(tagged, "moved")  # read again for the row counts of its cases
    late = disorder.late_flags(tagged)
    return late.groupBy("setting").agg(F.count(F.when(F.col("late"), 1)).alias("n_late"), F.count(F.lit(1)).alias("n_events"))


# --- conformance -----------------------------------------------------------------------------------------------------


@query
def conforming_events(spark, sf_dir):
    """In order, an event costs nothing exactly if the case so far is a path of the model, and at most one per later event."""
    m = _model(spark, sf_dir, "users")
    out = check(user_day_log(spark, sf_dir), m).select("arrival_seq", "cost")
    at = matching.replay(matching.case_prefixes(user_day_log(spark, sf_dir)), m.nodes)
    first_miss = Window.partitionBy("case_id").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("matched", F.count("first_trace").over(first_miss)).select("case_id", "arrival_seq", "level", "matched")
    joined = at.join(out, "arrival_seq")
    return joined.select(
        "case_id", "arrival_seq", "matched", (F.col("cost") == 0).alias("conforms"), (F.col("cost") <= F.col("level") - F.col("matched")).alias("bounded")
    )


@query
def first_event_cost(spark, sf_dir):
    out = check(orders_log(spark, sf_dir), _model(spark, sf_dir, "users"))
    return out.groupBy("case_id").agg(F.min_by("cost", "arrival_seq").cast("bigint").alias("cost"))


@query
def fold_flags(spark, sf_dir):
    """The fold sees exactly the late events that the whole case history has."""
    out = check(orders_log(spark, sf_dir), _model(spark, sf_dir, "orders"))
    return out.select("arrival_seq", "flag")


def _orders_check(spark, sf_dir, p: Params) -> DataFrame:
    out = check(orders_log(spark, sf_dir), _model(spark, sf_dir, "orders"), p)
    return out.select("case_id", "activity", "arrival_seq", "cost", "n_states", "open_events", "flag", "replayed", "complete_cost")


@query
def conformance_none(spark, sf_dir):
    return _orders_check(spark, sf_dir, Params())


@query
def conformance_ngrams(spark, sf_dir):
    return _orders_check(spark, sf_dir, Params(order="ngrams"))


@query
def conformance_greedy(spark, sf_dir):
    return _orders_check(spark, sf_dir, Params(order="greedy"))


@query
def conformance_non_adaptive(spark, sf_dir):
    return _orders_check(spark, sf_dir, Params(adaptable=False))


@query
def conformance_unaware(spark, sf_dir):
    return _orders_check(spark, sf_dir, Params(event_time_aware=False))


@query
def conformance_user_days(spark, sf_dir):
    out = check(user_day_log(spark, sf_dir), _model(spark, sf_dir, "users"))
    return out.select("case_id", "activity", "arrival_seq", "cost", "n_states", "open_events", "complete_cost")


@query
def complete_cost(spark, sf_dir):
    """Cost of each case if it ends after its last event."""
    out = _orders_check(spark, sf_dir, Params())
    return out.groupBy("case_id").agg(
        F.max_by("cost", "arrival_seq").alias("cost"), F.max_by("complete_cost", "arrival_seq").alias("complete_cost")
    )


@query
def state_counts(spark, sf_dir):
    """Cases and states in memory after the last event of every case."""
    out = _orders_check(spark, sf_dir, Params())
    last = out.groupBy("case_id").agg(F.max_by(F.struct("n_states", "open_events"), "arrival_seq").alias("s"))
    return last.agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum("s.n_states").alias("n_states"), F.max("s.open_events").alias("max_open_events")
    )


@query
def state_order(spark, sf_dir):
    """The states kept after the last event of each case, in the order of their cost."""
    kept = retained(orders_log(spark, sf_dir), _model(spark, sf_dir, "orders"))
    rank = F.rank().over(Window.partitionBy("case_id").orderBy("base_cost"))  # as many rows as states of one case
    named = _named(spark, sf_dir, "orders", kept.withColumn("cost_rank", rank))
    return named.select("case_id", "open_events", "first_trace", "level", F.col("base_cost").alias("cost"), "cost_rank")


@query
def prefix_alignments(spark, sf_dir):
    """The reported alignment of every event of the short user-day cases."""
    out = check(user_day_log(spark, sf_dir), _model(spark, sf_dir, "users"), Params(), alignments=True)
    return out.select(
        "case_id", "arrival_seq", "cost", al.text(F.col("alignment")).alias("alignment"),
        "complete_cost", al.text(F.col("complete_alignment")).alias("complete_alignment"),
    )


@query
def alignment_invariants(spark, sf_dir):
    """Each alignment costs what is reported, its log side is the case so far, its model side is a path of the model, and
    the complete one ends at the end of a trace."""
    log, nodes = user_day_log(spark, sf_dir), _model(spark, sf_dir, "users").nodes
    out = check(log, _model(spark, sf_dir, "users"), Params(), alignments=True)
    zero = F.lit(0).cast("bigint")
    side = lambda c, s: F.transform(F.filter(c, lambda m: m[s].isNotNull()), lambda m: m[s])
    path = lambda c, s, mark: matching.walked(side(F.col(c), s), [zero] * 3, tuple(f"{mark}_{n}" for n in md.NODE))
    # sides as identities: alignments are read once and not moved
    out = out.select(
        "arrival_seq",
        (al.total_cost(F.col("alignment")) == F.col("cost")).alias("cost_ok"),
        (al.total_cost(F.col("complete_alignment")) == F.col("complete_cost")).alias("complete_cost_ok"),
        al.trace_size(F.col("alignment")).cast("bigint").alias("trace_size"),
        *path("alignment", "log", "log"), *path("alignment", "model", "model"), *path("complete_alignment", "model", "end"),
    )
    # the whole log side, by the running hash over (position, activity), from the log itself
    seen = matching.case_prefixes(messages.usable(log), md.BY_ARRIVAL)
    out = out.join(seen.select("arrival_seq", *[F.col(c).alias(f"seen_{c}") for c in md.NODE]), "arrival_seq")
    at = lambda of, mark, name: of.select(*[F.col(c).alias(f"{mark}_{c}") for c in md.NODE], F.col("first_trace").alias(name))
    for of, mark, name in ((nodes, "model", "on_path"), (nodes.filter("is_end"), "end", "at_end")):
        out = out.join(at(of, mark, name), [f"{mark}_{c}" for c in md.NODE], "left")
    return out.select(
        "arrival_seq",
        "cost_ok",
        "complete_cost_ok",
        ((F.col("log_level") == F.col("seen_level")) & (F.col("log_z1") == F.col("seen_z1")) & (F.col("log_z2") == F.col("seen_z2"))).alias("log_ok"),
        ((F.col("model_level") == 0) | F.col("on_path").isNotNull()).alias("model_ok"),
        F.col("at_end").isNotNull().alias("end_ok"),
        "trace_size",
    )


# --- experiments -----------------------------------------------------------------------------------------------------


@query
def active_cases(spark, sf_dir):
    return experiments.active_cases(user_day_log(spark, sf_dir), 1000)


@query
def param_grid(spark, sf_dir):
    data = user_log(spark, sf_dir).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"))
    return experiments.param_grid(spark, data, "ewma").select("case_id", "n_events", F.col("ewma").cast("double").alias("alpha"), "swap", "repetition")


def _results(spark, sf_dir) -> DataFrame:
    """Response rows whose file name codes the settings, from the orders table."""
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("timestamp")
    algo = F.element_at(F.lit(list(experiments.ALGORITHMS)), (F.col("o_custkey") % 5 + 1).cast("int"))
    swap = F.element_at(F.lit(experiments.SWAPS), (F.col("o_custkey") % 7 + 1).cast("int"))
    name = F.concat(F.lit("bpi2012__algo_"), algo, F.lit("__swap_"), swap, F.lit("_3_0.3_20240101_120000"))
    rows = o.select(
        F.col("o_custkey").cast("string").alias("case_id"), F.col("o_orderstatus").alias("activity"),
        (F.col("o_totalprice") % 10).cast("int").alias("cost"), F.floor(F.col("o_totalprice") % 7).alias("time_ms"),
        F.unix_millis(day).alias("emitted_at_ms"), F.concat(F.lit("output/orig/"), name).alias("filename"),
        F.struct(F.unix_millis(day).alias("t"), F.col("o_orderkey").alias("n")).alias("line"),
    )
    return rows.withColumns(labels.run_columns(labels.last_segment(F.col("filename")), "orig"))


SETTINGS = ["dataset", "algo", "swap"]


@query
def summary_case(spark, sf_dir):
    return experiments.per_case(_results(spark, sf_dir), SETTINGS)


@query
def summary_last_cost(spark, sf_dir):
    rows = experiments.numbered(experiments.last_cost(_results(spark, sf_dir)))
    return rows.select("case_id", F.col("line.n").alias("o_orderkey"), "algo", "swap", "cost", "rn")


@query
def summary_setting(spark, sf_dir):
    out = experiments.per_setting(experiments.per_case(_results(spark, sf_dir), SETTINGS), SETTINGS)
    return out.withColumns({c: F.round(c, 9) for c in ("time_per_event_ms", "cost_per_trace")})


@query
def experiment_orders(spark, sf_dir):
    """All five algorithms over the orders log as it is and with each swap setting, summarised per algorithm and setting.

    Runs are deterministic, so that the repetitions of a setting would be equal rows.
    """
    model = _model(spark, sf_dir, "orders")
    log = write_through(orders_log(spark, sf_dir), "log")
    swapped = disorder.inject_disorder(log).withColumnRenamed("setting", "swap")
    logs = log.withColumn("swap", F.lit("00")).unionByName(swapped.filter(F.col("swap").isin(experiments.SWAPS)))
    runs = experiments.run_grid(logs, model, experiments.ALGORITHMS, "orders")
    rows = runs.select("*", F.concat_ws("__", "dataset", "algo", "swap").alias("filename"), F.lit(0).cast("bigint").alias("time_ms"))
    cases = experiments.per_case(rows, SETTINGS, "arrival_seq")
    return experiments.per_setting(cases, SETTINGS).select(*SETTINGS, "cost", "event_count", "case_count", "cost_per_trace")


@query
def experiment_files(spark, sf_dir):
    """Runs of three algorithms written as result files, read back with the settings in their names, and summarised."""
    algorithms = {n: experiments.ALGORITHMS[n] for n in ("adaptive", "non_adaptive", "non_aware")}
    runs = experiments.run_grid({"00": orders_log(spark, sf_dir)}, _model(spark, sf_dir, "orders"), algorithms, "orders")
    rows = runs.select(
        F.concat_ws("", F.col("dataset"), F.lit("__algo_"), "algo", F.lit("__swap_"), "swap", F.lit("_3_0.3_0")).alias("run"), "case_id", "activity", "cost",
        F.lit(0).cast("bigint").alias("time_ms"), F.unix_millis("event_time").alias("emitted_at_ms"), "arrival_seq",
    )
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    experiments.write_results(rows, path)
    cases = experiments.per_case(experiments.read_results(spark, path), SETTINGS)
    return experiments.per_setting(cases, SETTINGS).select(*SETTINGS, "cost", "event_count", "case_count", F.round("cost_per_trace", 9).alias("cost_per_trace"))
