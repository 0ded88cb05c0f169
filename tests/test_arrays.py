"""Models beyond the broadcast: arrays read by tasks give what the broadcast tree gives; caches are bounded."""

import random

import pytest
from pyspark.sql import functions as F

from test_step import build_tree, random_traces
from test_third import random_log
from tracefold.functions import step, tree
from tracefold.operators import conformance, matching
from tracefold.operators.conformance import Model, check, retained
from tracefold.params import Params


def built(model):
    return tree.build(model.data(True))


@pytest.fixture(scope="module")
def both(make_log):
    log = random_log(make_log, 61, cases=60, letters="ABCD", late=0).cache()
    return Model(log), Model(log, max_nodes=10)


def test_arrays_are_the_tree(both):
    small, large = map(built, both)
    assert isinstance(large, tree.ArrayTree) and type(small) is tree.Tree
    for n in range(len(small.parent)):
        assert list(small.kids(n).items()) == list(large.kids(n).items())
        assert small.identity(n) == large.identity(n) and large.find(large.key(n)) == n
        assert all(getattr(small, c)[n] == getattr(large, c)[n] for c in ("parent", "level", "to_end", "height"))
        assert n == 0 or small.symbol[n] == large.symbol[n]


@pytest.mark.parametrize("params", [Params(), Params(order="ngrams"), Params(order="greedy")])
def test_the_size_of_the_model_changes_nothing(make_log, both, params):
    """Alignments, too: among equal ones the smallest node is taken, and nodes have one number."""
    log = random_log(make_log, 11, letters="ABCDX", late=0.5)
    small, large = (sorted(map(str, check(log, m, params, alignments=True).collect())) for m in both)
    assert small == large
    small, large = (sorted(map(str, retained(log, m, params).collect())) for m in both)
    assert small == large


def test_models_beyond_the_arrays_are_read_as_needed(make_log, both):
    log = random_log(make_log, 12, letters="ABCDX", late=0.5)
    tables = Model(both[0].log, max_nodes=10, max_array=10)
    assert isinstance(built(tables), tree.TableTree)
    small, large = (sorted(map(str, check(log, m).collect())) for m in (both[0], tables))
    assert small == large


def test_a_long_case_does_not_fill_the_caches(monkeypatch):
    monkeypatch.setattr(tree, "MEMO_LIMIT", 20)
    monkeypatch.setattr(tree, "KEPT_KIDS", 5)
    rng = random.Random(2)
    traces = random_traces(rng, "ABCD", 30)
    model, free = build_tree(traces), build_tree(traces)
    case, other = step.Case(0.3), step.Case(0.3)
    for i in range(400):
        a = rng.choice("ABCD")
        step.observe(model, Params(), case, model.number[a], i, None)
        assert len(model._memo) <= 20 and len(model._kids) <= 5
        with monkeypatch.context() as m:
            m.setattr(tree, "MEMO_LIMIT", 10**9)
            step.observe(free, Params(), other, free.number[a], i, None)
        assert (case.cost, step.states(case)) == (other.cost, step.states(other))


@pytest.mark.parametrize("min_decay,again", [(9, False), (2, True)])
def test_later_rounds_fold_only_where_a_life_changed(make_log, both, monkeypatch, min_decay, again):
    log = random_log(make_log, 13, letters="ABCDX", late=0.6, at=4)
    p = Params(order="greedy", alpha=0.3, min_decay=min_decay)
    rows, fold = [], conformance.fold
    monkeypatch.setattr(conformance, "fold", lambda log, *more: rows.append(log.count()) or fold(log, *more))
    got = sorted(map(str, check(log, both[0], p).collect()))
    assert rows[0] == log.count() and len(rows) > 1 and (sum(rows[1:]) > 0) == again
    monkeypatch.setattr(conformance, "_lives", lambda p, n, multiplier: F.col(multiplier))  # any change of a multiplier
    assert sorted(map(str, check(log, both[0], p).collect())) == got


def test_unseen_meets_each_known_activity_once(spark, make_log):
    log = make_log([("c", a, float(i), i) for i, a in enumerate("ABAC")])
    known = spark.createDataFrame([("A",)] * 50 + [(None,)], "activity string")
    out = matching.unseen(log, known)
    assert sorted(r.activity for r in out.collect()) == ["B", "C"]
    assert "Distinct" in out._jdf.queryExecution().analyzed().toString() or "Deduplicate" in out._jdf.queryExecution().analyzed().toString()


def test_any_order_below_a_start_meets_only_its_own_nodes(make_log, spark):
    """Groups of several sizes and starts: the same nodes as by trying every permutation."""
    import itertools

    traces = ["ABCA", "BACB", "ABAC", "CABB", "AABC"]
    model = Model(make_log([(f"m{i}", a, float(j), 10 * i + j) for i, t in enumerate(traces) for j, a in enumerate(t)]))
    named = {r["trace_id"] * 100 + r["level"]: r for r in model.rows.collect()}
    first = {(r["level"], r["z1"], r["z2"]): r["first_trace"] for r in model.nodes.collect()}
    prefix = {(r["level"], r["z1"], r["z2"]): traces[r["trace_id"] // 10][: r["level"]] for r in named.values()}
    groups, events, want, n = [], [], set(), 0
    for start, text in [((0, 0, 0), ""), *prefix.items()]:
        for bag in ("AB", "BC", "ABC", "AA"):
            groups.append((n, *start))
            events += [(n, a) for a in bag]
            for node, whole in prefix.items():
                if whole in {text + "".join(q) for q in itertools.permutations(bag)}:
                    want.add((n, start[0], node[0], first[node]))
            n += 1
    members = spark.createDataFrame(events, "group_id int, activity string")
    sums = members.select("group_id", *matching.bag_lanes("activity")).groupBy("group_id").agg(F.count("*").alias("n"), F.sum("b1").alias("g1"), F.sum("b2").alias("g2"))
    starts = spark.createDataFrame(groups, "group_id int, level long, z1 long, z2 long")
    found = matching.match_any_order(starts.join(sums, "group_id"), model.rows, model.nodes, events=members).collect()
    assert sorted((r.group_id, r.s_level, r.hit_level, r.first_trace) for r in found) == sorted(want) and want
