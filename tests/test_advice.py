"""Cases from the second review."""

from pyspark.sql import functions as F

from tracefold.operators import model as md
from tracefold.operators import ordering


def test_tie_groups_of_any_size_keep_their_events(make_log):
    rows = [("big", "AB"[i % 2], 1.0, i) for i in range(12)]
    rows += [("small", a, 5.0, 20 + i) for i, a in enumerate("CBA")]
    patterns = md.ngrams(make_log([("m", a, float(i), i) for i, a in enumerate("ABCXABC")]), 3)
    events = ordering.ordered_events(make_log(rows), patterns)
    assert sorted((r["arrival_seq"], r["place"]) for r in events.filter("case_id = 'big'").collect()) == [(i, i + 1) for i in range(12)]
    got = {r["case_id"]: (r["n_tied"], "".join(r["delivered"]), "".join(r["ordered"]), r["freq"]) for r in ordering.as_groups(events).collect()}
    assert got == {"big": (12, "AB" * 6, "AB" * 6, None), "small": (3, "CBA", "ABC", 2)}


def test_equal_activities_of_a_tie_keep_their_order(make_log):
    patterns = md.ngrams(make_log([("m", a, float(i), i) for i, a in enumerate("ABA")]), 3)
    events = ordering.ordered_events(make_log([("x", a, 1.0, i) for i, a in enumerate("AAB")]), patterns)
    assert sorted((r["arrival_seq"], r["place"], r["freq"]) for r in events.collect()) == [(0, 1, 1), (1, 3, 1), (2, 2, 1)]


def test_tie_order_query_returns_large_groups(spark, make_log, monkeypatch):
    """The registered query on a log with a group longer than any pattern (10)."""
    from tracefold.plans import queries

    log = make_log([("x", "AB"[i % 2], 1.0, i) for i in range(12)]).cache()
    monkeypatch.setattr(queries, "orders_log", lambda spark, sf_dir: log)
    monkeypatch.setattr(queries, "_model", lambda *a: queries.Model(log))
    assert [(r["n_tied"], r["delivered"], r["ordered"]) for r in queries.tie_order_ngrams(spark, "").collect()] == [(12, *[",".join("AB" * 6)] * 2)]


def test_alignment_invariants_see_the_whole_log_side(spark, make_log, monkeypatch):
    """A wrong first move of a case of 12 events."""
    from tracefold.plans import queries

    log = make_log([("x", a, float(i), i) for i, a in enumerate("ABCDEFGHIJKL")]).cache()
    model = queries.Model(log)
    monkeypatch.setattr(queries, "user_day_log", lambda spark, sf_dir: log)
    monkeypatch.setattr(queries, "_model", lambda *a: model)
    ok = {r["arrival_seq"]: r["log_ok"] for r in queries.alignment_invariants(spark, "").collect()}
    assert ok == {i: True for i in range(12)}
    check = queries.check

    def wrong(*args, **more):
        first = lambda m, i: F.when(i == 0, m.withField("log", F.lit("Z"))).otherwise(m)
        return check(*args, **more).withColumn("alignment", F.transform("alignment", first))

    monkeypatch.setattr(queries, "check", wrong)
    assert not any(r["log_ok"] for r in queries.alignment_invariants(spark, "").collect())


def test_experiment_runs_every_swap_setting(spark):
    from tracefold.operators import experiments
    from tracefold.plans import queries

    rows = queries.experiment_orders(spark, "/root/testdata/sf0.001").collect()
    assert {(r["algo"], r["swap"]) for r in rows} == {(a, s) for a in experiments.ALGORITHMS for s in experiments.SWAPS} and len(rows) == 35
    assert {(r["case_count"], r["event_count"]) for r in rows} == {(rows[0]["case_count"], 1500)}
