"""Finding of the fourth round: experiment_orders, whose runs share what they have in common."""

import random

import pytest
from pyspark.sql import functions as F

from test_step import build_tree, random_traces
from tracefold.functions import step
from tracefold.operators import conformance, disorder, experiments
from tracefold.operators.conformance import Model, check
from tracefold.params import Params

SETS = [*experiments.ALGORITHMS.values(), Params(min_decay=1), Params(min_decay=2, multiplier=0.9), Params(discounted=False, order="greedy"), Params(discounted=False, adaptable=False)]


def _events(rng, n):
    return [(rng.choice("ABCDX"), max(0, t // 2 - rng.choice((0, 0, 1, 3)))) for t in range(n)]


@pytest.mark.parametrize("kept", [3, 30_000])
def test_runs_that_share_are_the_single_runs(monkeypatch, kept):
    """every set at once, with ties, late events, unknown activities and multipliers that drift apart; also if hardly anything is remembered."""
    monkeypatch.setattr(step, "KEPT_STATES", kept)
    for seed in range(12):
        rng = random.Random(seed)
        model = build_tree(random_traces(rng, "ABCD", 40))
        runs = step.Runs(model, SETS)
        for _ in range(15):
            case, alone = runs.begin(), [step.Case(p.multiplier) for p in SETS]
            for a, ts in _events(rng, rng.randint(1, 14)):
                sym, got = model.number.get(a, a), [None] * len(SETS)
                mults = [p.multiplier if not p.adapts else rng.choice((0.3, 0.6, 0.6, 0.95)) for p in SETS]
                case = runs.observe(case, sym, ts, mults, got)
                for i, (p, c) in enumerate(zip(SETS, alone)):
                    flag, redone = step.observe(model, p, c, sym, ts, mults[i])
                    assert got[i] == (c.cost, step.states(c), c.gens[0][0], flag, redone, step.complete_cost(model, c))
            assert len(runs._states) <= kept


def test_runs_in_common_are_taken_once(monkeypatch):
    """equal logs under all algorithms cost as many steps as one log under one of them, as long as no event is late."""
    rng, calls = random.Random(3), []
    model = build_tree(random_traces(rng, "ABCD", 40))
    after = step.Runs._after
    monkeypatch.setattr(step.Runs, "_after", lambda self, *a: calls.append(1) or after(self, *a))
    sets = list(experiments.ALGORITHMS.values())
    runs = step.Runs(model, sets)
    for _ in range(7):
        case = runs.begin()
        for t, a in enumerate("ABCDABCDAB"):
            case = runs.observe(case, model.number[a], t, [0.3] * len(sets), [None] * len(sets))
    assert len(calls) == 10


def _log(make_log, seed, cases, n, ties):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += 0 if rng.random() < ties else 1
        rows.append((f"c{rng.randrange(cases)}", rng.choice("ABC"), float(max(0, at - rng.choice((0, 0, 0, 5)))), i))
    return make_log(rows)


def test_only_cases_with_ties_are_folded_for_their_flags(make_log, monkeypatch):
    """the others have their flags from the start."""
    rows = [(f"c{i % 20}", "ABC"[i * 7 % 3], float(i - (45 if i % 6 == 0 else 0)), i) for i in range(300)]
    rows += [("tied", a, 500.0, 300 + i) for i, a in enumerate("BACA")]
    log, model = make_log(rows), Model(make_log([(c, a, float(i), i) for i, (c, a, _, _) in enumerate(rows)]))
    folded, fold = [], conformance.fold
    monkeypatch.setattr(conformance, "fold", lambda rows, *a: folded.append({r["case_id"] for r in rows.select("case_id").collect()}) or fold(rows, *a))
    sets = [Params(order="ngrams", alpha=0.3), Params(order="greedy", alpha=0.3), Params(alpha=0.3)]
    assert check(log, model, sets).count() == 3 * len(rows)
    assert folded and all(f == {"tied"} for f in folded)


@pytest.mark.parametrize("ties,limit", [(0.1, None), (0.6, None), (0.6, 25)])
def test_flags_and_multipliers_settle(make_log, ties, limit):
    """at the end the multipliers are those of the flags that the fold gives, in delivery order."""
    log, model = _log(make_log, 5, 8, 160, ties), Model(_log(make_log, 6, 30, 160, 0))
    sets = [Params(order="ngrams", alpha=0.3), Params(order="greedy", alpha=0.2), Params(alpha=0.3), Params(min_decay=1, alpha=0.3), Params(adaptable=False)]
    plan = conformance.FoldPlan.of(log, limit)
    got = {r["arrival_seq"]: r for r in conformance.multipliers(log, model, sets, plan, None).collect()}
    rows = check(log, model, sets, limit=limit).collect()
    assert len(got) == 160 and len(rows) == 160 * len(sets)
    for i, p in enumerate(sets[:4]):
        m = p.multiplier
        for r in sorted((r for r in rows if r["setting"] == i), key=lambda r: r["arrival_seq"]):
            if r["flag"] is not None:
                m = max(p.multiplier, p.alpha * r["flag"] + (1 - p.alpha) * m)
            assert got[r["arrival_seq"]][f"_m{i}"] == pytest.approx(m, abs=1e-12)
        alone = check(log, model, p).collect()
        name = lambda r: (r["arrival_seq"], *[r[c] for c in conformance.RESULT])
        assert sorted(map(name, alone)) == sorted(name(r) for r in rows if r["setting"] == i)


@pytest.mark.parametrize("keys", [[], ["case_id"], ["k"]])
def test_blocks_of_the_delivery(spark, make_log, monkeypatch, keys):
    """blocks of any size, null keys, rows that come twice and an empty log."""
    log = _log(make_log, 9, 6, 200, 0.3).withColumn("k", F.when(F.col("arrival_seq") % 3 > 0, F.col("arrival_seq") % 3))
    log = log.unionByName(log.filter("arrival_seq % 50 = 0"))
    flagged = disorder.first_flags(log, "none")
    rows = flagged.filter("arrival_seq % 50 > 0").collect()
    monkeypatch.setattr(disorder, "BLOCK", 7)
    made = disorder.Delivery(log, keys, 5)
    assert made.rows.count() == log.count() and made.blocks.count() == made.rows.select("_block").distinct().count()
    assert made.rows.groupBy("_block").count().agg(F.max("count")).first()[0] <= 7
    assert made.rows.select("_block", "_at").distinct().count() == log.count()
    single = log.filter("arrival_seq % 50 > 0")
    made = disorder.Delivery(single, keys, 5)
    found = made.averages({0: (0.05, 0.3, True), 2: (0.3, 0.2, True)}, fan=3)
    joined = made.rows.join(found, "_block").select("arrival_seq", made.flag("none").alias("flag"), *[F.element_at(m, F.col("_at") + 1).alias(m) for m in ("_m0", "_m2")]).collect()
    got, flags = {r["arrival_seq"]: r for r in joined}, {r["arrival_seq"]: r["flag"] for r in disorder.first_flags(single, "none").collect()}
    assert len(joined) == len(rows) and {i: r["flag"] for i, r in got.items()} == flags
    for name, alpha, floor in (("_m0", 0.05, 0.3), ("_m2", 0.3, 0.2)):
        m = {}
        for r in sorted(rows, key=lambda r: r["arrival_seq"]):
            key, flag = tuple(r[k] for k in keys), flags[r["arrival_seq"]]
            if flag is not None:
                m[key] = max(floor, alpha * flag + (1 - alpha) * m.get(key, floor))
            assert got[r["arrival_seq"]][name] == pytest.approx(m.get(key, floor), abs=1e-12)
    assert disorder.Delivery(log.limit(0), keys, 5).averages({0: (0.05, 0.3, True)}).count() == 0


@pytest.mark.parametrize("p", [Params(order="ngrams", alpha=0.3), Params(order="greedy", alpha=0.3)])
def test_rows_that_come_twice_settle(make_log, monkeypatch, p):
    """their order may not change from round to round."""
    log, model = _log(make_log, 12, 6, 90, 0.2), Model(_log(make_log, 6, 30, 90, 0))
    rounds, through = [], conformance.write_through

    def counted(df, name):
        assert len(rounds) < 40
        rounds.append(name)
        return through(df, name)

    monkeypatch.setattr(conformance, "write_through", counted)
    got = check(log.unionByName(log), model, [p, Params()]).groupBy("setting").count().collect()
    assert {r["setting"]: r["count"] for r in got} == {0: 180, 1: 180}
