"""Model and matching operators on the hand-worked log."""

import pytest
from pyspark.sql import functions as F

from naive import Naive
from conftest import FIXTURE_TRACES
from tracefold.operators import experiments, matching, ordering
from tracefold.operators import model as md
from tracefold.operators.conformance import Model, check
from tracefold.params import Params

FIRST = {"123": 0, "223": 7, "323": 13}


def test_statistics(fixture_model):
    row = md.model_stats(fixture_model.rows, fixture_model.nodes).first().asDict()
    assert row == {"leaf_visits": 3, "avg_len": 6, "max_len": 7, "min_len": 6, "n_nodes": 15, "n_events": 20, "shortest_trace": 7}


def test_ngrams(fixture_log):
    got = {"".join(r["pattern"]): r["freq"] for r in md.ngrams(fixture_log).collect()}
    assert got["AA"] == 4 and got["BD"] == got["DE"] == got["BDE"] == 3
    assert all(got[p] == 2 for p in ("AB", "AAB", "CB", "CBD", "CBDE"))
    assert all(got[p] == 1 for p in ("AAA", "AC", "EF", "DEF", "BDEF"))
    assert md.ngrams(fixture_log, 0).count() == 0


def test_ngrams_across_blocks(fixture_log):
    assert md.ngrams(fixture_log).exceptAll(md.ngrams(fixture_log, limit=3)).count() == 0


def test_end_inside_a_longer_trace(make_log):
    rows = [("a", s, float(i), i) for i, s in enumerate("AB")] + [("b", s, float(i), 10 + i) for i, s in enumerate("A")]
    m = Model(make_log(rows + [("c", s, float(i), 20 + i) for i, s in enumerate("AB")]))
    nodes = {r["level"]: r for r in m.nodes.collect()}
    assert nodes[1]["is_end"] and nodes[1]["min_to_end"] == 0 and nodes[1]["max_to_end"] == 1 and nodes[1]["first_end"] == 10
    # visits: AB at the first trace, A at the second, A and AB at the third
    assert md.leaf_visits(m.rows, m.nodes).count() == 4
    assert m.avg_len == (2 + 1 + 1 + 2) // 4


def test_strict_replay(fixture_model, make_log):
    log = make_log([("t", a, t, i) for i, (a, t) in enumerate(zip("AADEF", [1.0, 2, 3, 3, 3]))] + [("u", "Z", 1.0, 9)])
    got = {r["case_id"]: r for r in matching.longest_prefix(matching.case_prefixes(log), fixture_model.nodes).collect()}
    assert got["t"]["matched"] == 2 and got["u"]["matched"] is None


def test_permutations_and_best_leaf(fixture_model, spark):
    nodes = fixture_model.nodes
    groups = spark.createDataFrame([(1, "BAA"), (2, "FA"), (3, "CBAA")], "group_id int, s string")
    groups = groups.select("group_id", F.explode(F.split("s", "")).alias("activity")).filter("activity <> ''")
    zero = F.lit(0).cast("bigint")
    groups = groups.select("group_id", *matching.bag_lanes("activity")).groupBy("group_id").agg(
        F.count("*").alias("n"), F.sum("b1").alias("g1"), F.sum("b2").alias("g2")
    ).withColumns({"level": zero, "z1": zero, "z2": zero})
    hits = matching.match_any_order(groups, fixture_model.rows, nodes).select("group_id", "first_trace", "hit_level").collect()
    assert sorted(map(tuple, hits)) == [(1, 0, 3), (3, 0, 4)]
    states = spark.createDataFrame([(1, 0, 2, ["D", "E", "F"], 0, 9), (2, 0, 2, ["D", "E", "F"], 0, 1), (3, 13, 3, [], 2, 9)],
                                   "state_id int, first_trace bigint, level bigint, postfix array<string>, base_cost int, cost_limit int")
    got = {r["state_id"]: (r["cost"], r["leaf_level"]) for r in matching.best_leaf(states, fixture_model).collect()}
    assert got == {1: (1, 6), 3: (6, 7)}


def test_best_leaf_against_all_ends(fixture_model, spark):
    slow = Naive(FIXTURE_TRACES.values(), Params())
    ends = [tuple(t) for t in FIXTURE_TRACES.values()]

    def indel(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], max(row[j + 1], row[j], prev + 1 if x == y else 0)
        return len(a) + len(b) - 2 * row[-1]

    names = {(r["first_trace"], r["level"]): None for r in fixture_model.nodes.collect()}
    texts = {(r["first_trace"], r["level"]): tuple(r["prefix"].split("->")) for r in md.prefix_text(fixture_model.rows, fixture_model.nodes).collect()}
    cases = [(i, *k, list(post), 0, 8) for i, (k, post) in enumerate((k, p) for k in names for p in ("", "D", "BD", "EDB"))]
    states = spark.createDataFrame(cases, "state_id int, first_trace bigint, level bigint, postfix array<string>, base_cost int, cost_limit int")
    got = {r["state_id"]: r["cost"] for r in matching.best_leaf(states, fixture_model).collect()}
    want = {}
    for i, ft, lv, post, _, limit in cases:
        at = texts[(ft, lv)]
        below = [indel(tuple(post), e[len(at):]) for e in ends if len(e) > len(at) and e[: len(at)] == at]
        if below and min(below) < limit:
            want[i] = min(below)
    assert got == want
    assert set(texts.values()) == {n for n in slow.nodes if n}


@pytest.mark.parametrize("order", ["none", "ngrams", "greedy"])
def test_golden_tie(fixture_model, make_log, order):
    log = make_log([("123", a, t, i) for i, (a, t) in enumerate(zip("AADEF", [1.0, 2, 3, 3, 3]))])
    out = check(log, fixture_model, Params(order=order)).orderBy("arrival_seq").collect()
    assert [r["cost"] for r in out] == [0, 0, 1, 1, 1]
    assert out[-1]["complete_cost"] == 1
    if order == "ngrams":
        assert [r["flag"] for r in out] == [None, 0, 0, None, None] and out[-1]["open_events"] == 2


def test_golden_late(fixture_model, make_log):
    log = make_log([("x", a, t, i) for i, (a, t) in enumerate(zip("ADAE", [1.0, 3, 2, 4]))])
    out = check(log, fixture_model, Params(), alignments=True).orderBy("arrival_seq").collect()
    assert [r["cost"] for r in out] == [0, 1, 1, 1]
    assert [r["flag"] for r in out] == [None, 0, 1, 0] and out[2]["replayed"] == 2
    assert [(m["log"], m["model"]) for m in out[3]["alignment"]] == [("A", "A"), ("A", "A"), (None, "B"), ("D", "D"), ("E", "E")]
    unaware = check(log, fixture_model, Params(event_time_aware=False)).orderBy("arrival_seq").collect()
    assert [r["cost"] for r in unaware] == [0, 1, 1, 2]


def test_milliseconds_decide_ties(fixture_model, make_log):
    log = make_log([("x", "A", 1.0, 0), ("x", "A", 2.0004, 1), ("x", "B", 2.0001, 2)])
    assert [r["flag"] for r in check(log, fixture_model, Params()).orderBy("arrival_seq").collect()] == [None, 0, 0]
    assert ordering.tie_sizes(log).count() == 1


def test_large_ties_stay_as_delivered(make_log):
    log = make_log([("x", "AB"[i % 2], 1.0, i) for i in range(12)])
    done = ordering.as_groups(ordering.ordered_events(log, md.ngrams(log, 3))).collect()
    assert [(r["n_tied"], r["ordered"]) for r in done] == [(12, [*"AB" * 6])]


def test_grid_runs_in_one_job(fixture_model, fixture_log):
    out = experiments.run_grid({"00": fixture_log}, fixture_model, experiments.ALGORITHMS, "d")
    got = {r["algo"]: (r["n"], r["c"]) for r in out.groupBy("algo").agg(F.count("*").alias("n"), F.sum("cost").alias("c")).collect()}
    assert got == {a: (20, 0) for a in experiments.ALGORITHMS}
