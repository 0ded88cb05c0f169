"""The paths for hot keys and large models give what the plain paths give."""

import random

import pytest
from pyspark.sql import functions as F

from tracefold.operators import disorder
from tracefold.operators.conformance import Model, check
from tracefold.operators.hotkeys import position, running
from tracefold.params import Params


@pytest.fixture(scope="module")
def skewed(make_log):
    """One case holds more than half of the rows."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        case = "hot" if rng.random() < 0.6 else f"c{rng.randint(0, 30)}"
        rows.append((case, rng.choice("ABCD"), float(i // 2 + rng.randint(-6, 6)), i * 3))
    return make_log(rows).cache()


@pytest.fixture(scope="module")
def small_model(make_log):
    rng = random.Random(4)
    rows, n = [], 0
    for c in range(12):
        for i in range(rng.randint(2, 7)):
            rows.append((f"m{c}", rng.choice("ABCD"), float(i), n))
            n += 1
    return Model(make_log(rows))


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_running_values(skewed):
    for keys, order in ((["case_id"], ["event_time", "arrival_seq"]), ([], ["arrival_seq"])):
        same(position(skewed, keys, order), position(skewed, keys, order, limit=40))
    aggs = {"m": ("max", F.unix_millis("event_time")), "s": ("sum", F.col("arrival_seq")), "z": ("xor", F.xxhash64("arrival_seq"))}
    same(running(skewed, ["case_id"], ["arrival_seq"], aggs), running(skewed, ["case_id"], ["arrival_seq"], aggs, limit=40))


def test_all_rows_at_one_time(make_log):
    log = make_log([("x", "A", 1.0, i) for i in range(200)])
    same(position(log, ["case_id"], ["event_time", "arrival_seq"]), position(log, ["case_id"], ["event_time", "arrival_seq"], limit=30))


def test_replay_size(skewed):
    rows = skewed.select("case_id", F.unix_millis("event_time").alias("t"), "arrival_seq").collect()
    want = {r.arrival_seq: sum(o.case_id == r.case_id and o.arrival_seq < r.arrival_seq and o.t > r.t for o in rows) for r in rows}
    for limit in (None, 40):
        got = {r["arrival_seq"]: r["replay"] for r in disorder.replay_size(skewed, limit).collect()}
        assert got == want


@pytest.mark.parametrize("keys", [[], ["case_id"]])
def test_blocked_average_equals_sequence(skewed, keys):
    flagged = disorder.first_flags(skewed, "none")
    m, want = {}, {}
    for r in flagged.orderBy("arrival_seq").collect():
        k = r["case_id"] if keys else None
        if r["flag"] is not None:
            m[k] = max(0.3, 0.05 * r["flag"] + 0.95 * m.get(k, 0.3))
        want[r["arrival_seq"]] = m.get(k, 0.3)
    for limit in (None, 40):
        got = {r["arrival_seq"]: r["multiplier"] for r in disorder.ewma_multiplier(flagged, 0.05, 0.3, limit, keys).collect()}
        assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("p", [Params(adaptable=False, order="greedy"), Params(alpha=0.05)])
def test_hot_case_in_blocks(skewed, small_model, p):
    same(check(skewed, small_model, p), check(skewed, small_model, p, limit=40))


def test_model_too_large_for_broadcast(skewed, small_model):
    other = Model(small_model.log, max_nodes=10, max_patterns=10)
    p = Params(order="ngrams", adaptable=False)
    assert "path" in other.ship(True).value and "path" in other.ship(True).value["patterns"] and "path" not in small_model.ship(True).value
    same(check(skewed, small_model, p), check(skewed, other, p))


def test_disorder_moves_but_keeps(skewed):
    moved = disorder.inject_disorder(skewed, {"50": 4, "99": 9})
    assert moved.count() == 2 * skewed.count()
    for s in ("50", "99"):
        one = moved.filter(F.col("setting") == s)
        same(one.select("case_id", "activity", "event_time"), skewed.select("case_id", "activity", "event_time"))
        same(one.select("case_id", "arrival_seq"), skewed.select("case_id", "arrival_seq"))
        assert one.select("case_id", "activity", "event_time", "arrival_seq").exceptAll(skewed).count() > 0


def test_many_hot_keys_are_joined(skewed, monkeypatch):
    """Beyond the bound of the broadcast, hot keys are joined; a key over the limit is cut however long the log is."""
    from tracefold.operators import hotkeys

    want = position(skewed, ["case_id"], ["event_time", "arrival_seq"])
    monkeypatch.setattr(hotkeys, "MAX_BROADCAST_KEYS", 0)
    same(want, position(skewed, ["case_id"], ["event_time", "arrival_seq"], limit=3))
    cut, some = hotkeys.with_chunks(skewed, ["case_id"], ["arrival_seq"], 3)
    assert some and cut.filter(F.col(hotkeys.CHUNK) > 0).select("case_id").distinct().count() > 3
