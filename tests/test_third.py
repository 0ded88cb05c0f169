"""Cases from the third round: the fold as SQL on random logs, retained states, leaf search, damaged events, replay sizes."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tracefold import session
from tracefold.operators import disorder, experiments, matching
from tracefold.operators.conformance import Model, check, retained
from tracefold.params import Params
from tracefold.plans.fold_sql import fold_sql
from tracefold.sources import messages


def random_log(make_log, seed, cases=25, letters="ABC", late=0.3, at=10):
    draw, rows, n = random.Random(seed), [], 0
    for c in range(cases):
        for i in range(draw.randrange(1, 14)):
            rows.append((f"c{c}", draw.choice(letters), float(i + (draw.randrange(-at, at) if draw.random() < late else 0)), n))
            n += 1
    draw.shuffle(rows)
    return make_log([(c, a, t + 100, i) for i, (c, a, t, _) in enumerate(rows)])


@pytest.mark.parametrize("seed,late,params", [
    (1, 0.0, Params()), (2, 0.4, Params()), (3, 0.9, Params(adaptable=False)), (4, 0.4, Params(event_time_aware=False)), (5, 0.5, Params(adaptable=False, min_decay=2, multiplier=0.9)),
    (6, 0.5, Params(alpha=0.3)), (7, 0.2, Params(min_decay=6)),
])
def test_fold_is_its_sql(make_log, seed, late, params):
    """Both engines on logs with late, equal and unordered times, and symbols in the log that the model lacks."""
    log, model = random_log(make_log, seed, letters="ABCX", late=late), random_log(make_log, seed + 50, letters="ABC", late=0)
    got = check(log, Model(model), params).select("arrival_seq", "cost", "n_states", "open_events", "flag", "replayed", "complete_cost")
    con = duckdb.connect()
    con.register("l", log.toArrow())
    con.register("m", model.toArrow())
    text = fold_sql("SELECT arrival_seq, cost, n_states, open_events, flag, replayed, complete_cost FROM fold", "SELECT * FROM l", "SELECT * FROM m", aware=params.event_time_aware,
                    adaptive=params.adapts, min_decay=params.min_decay, multiplier=params.multiplier, alpha=params.alpha)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(text).fetchall())


def test_retained_states_are_those_of_the_last_event(make_log):
    log = random_log(make_log, 8)
    model = Model(random_log(make_log, 58, late=0))
    for p in (Params(), Params(adaptable=False), Params(order="ngrams"), Params(event_time_aware=False)):
        last = check(log, model, p).groupBy("case_id").agg(F.max_by(F.struct("n_states", "open_events", "complete_cost"), "arrival_seq").alias("s")).select("case_id", "s.*")
        kept = retained(log, model, p)
        states = kept.groupBy("case_id").agg(F.count("*").alias("n_states"), F.max("open_events").alias("open_events"), F.max("complete_cost").alias("complete_cost"))
        assert sorted(map(tuple, states.collect())) == sorted(map(tuple, last.collect()))
        assert kept.filter("size(postfix) <> open_events").isEmpty()


def test_best_leaf_of_long_postfixes(make_log):
    """More open events than the four that were once looked at."""
    model = Model(make_log([("m", a, float(i), i) for i, a in enumerate("ABCDEFGHIJ")] + [("n", a, float(i), 20 + i) for i, a in enumerate("ABXYZ")]))
    rows = model.rows.filter("trace_id = 0 AND level = 2").select("level", "z1", "z2")
    states = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("state_id"), F.array(*map(F.lit, p)).alias("postfix")) for i, p in enumerate(["CDEFGHI", "XYZ", "CDQFGHIJ", "QQQ"])])).alias("s"), *rows.columns)
    states = states.select("s.*", *rows.columns, F.lit(2).alias("base_cost"), F.lit(9).alias("cost_limit"))
    assert {r["state_id"]: (r["cost"], r["leaf_level"]) for r in matching.best_leaf(states, model).collect()} == {0: (3, 10), 1: (2, 5), 2: (4, 10), 3: (8, 5)}
    assert matching.best_leaf(states.filter("false"), model).count() == 0


def test_damaged_events_are_put_aside(make_log):
    log = random_log(make_log, 9)
    bad = log.limit(4).withColumn("arrival_seq", F.col("arrival_seq") + 10_000)
    bad = bad.select(F.when(F.col("arrival_seq") % 2 == 0, F.col("case_id")).alias("case_id"), F.lit("").alias("activity"), F.lit(None).cast("timestamp").alias("event_time"), "arrival_seq")
    both, model = log.unionByName(bad).cache(), Model(log)
    for p in (Params(), Params(order="greedy"), Params(event_time_aware=False)):
        assert sorted(r.arrival_seq for r in check(both, model, p).collect()) == sorted(r.arrival_seq for r in log.collect())
    assert {r.reason for r in messages.rejected(both).collect()} <= {"no case", "no activity"} and messages.rejected(both).count() == 4
    texts = [("a/c/x", '{"event": {"time:timestamp": "2024-01-01T00:00:00.000+0000"}}', 1), ("a/c/x", "{", 2), ("x", None, 3), (None, None, 4), ("a/c/", "{}", 5), ("a/c/x", '{"event": {"time:timestamp": "2024-01-01T00:00:00.000+0000"}}', None)]
    parsed = messages.parse_messages(log.sparkSession.createDataFrame(texts, "topic string, payload string, arrival_seq long"))
    assert [r.arrival_seq for r in messages.usable(parsed).collect()] == [1]
    assert {r.arrival_seq: r.reason for r in messages.rejected(parsed).collect()} == {2: "no time", 3: "no case", 4: "no case", 5: "no activity", None: "no place in the delivery order"}


def test_replay_sizes_of_equal_times(make_log):
    for seed in (1, 2):
        log = random_log(make_log, seed, cases=6, late=0.8, at=4)
        rows = sorted((r.arrival_seq, r.case_id, r.event_time) for r in log.collect())
        expect = {s: sum(c2 == c and t2 > t for s2, c2, t2 in rows if s2 < s) for s, c, t in rows}
        assert {r.arrival_seq: r.replay for r in disorder.replay_size(log).collect()} == expect
        assert {r.arrival_seq: r.replay for r in disorder.replay_size(log, 5).collect()} == expect


def test_lines_are_numbered_in_files_of_any_length(spark, monkeypatch):
    rows = [(f"f{i % 2}", f"c{i % 5}", i % 7, (i // 10, i)) for i in range(200)]
    results = spark.createDataFrame(rows, "filename string, case_id string, cost int, line struct<a: long, n: long>")
    got = {(r.filename, r.line.n): r.rn for r in experiments.numbered(results).collect()}
    assert got == {(f"f{i % 2}", i): i // 2 + 1 for i in range(200)}
    last = {(r.filename, r.case_id): r.cost for r in experiments.last_cost(results).collect()}
    assert last == {(f"f{i % 2}", f"c{i % 5}"): i % 7 for i in range(200)}


def test_shared_folder_without_a_setting(spark, monkeypatch):
    """A stock local session names no folder, and the setting can't be changed while it runs."""

    class Conf:
        def get(self, name, default):
            return default

        def set(self, *_):
            raise AssertionError("static")

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    folder = session.shared_dir(Session())
    assert folder == session.shared_dir(Session())

    class Cluster(Session):
        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        session.shared_dir(Cluster())


def test_bags_are_compared(make_log, fixture_model, spark):
    """A group whose sums agree with a path, but not its activities."""
    zero = F.lit(0).cast("bigint")
    sums = spark.createDataFrame([(1, a) for a in "BAA"], "group_id int, activity string").select("group_id", *matching.bag_lanes("activity"))
    groups = sums.groupBy("group_id").agg(F.count("*").alias("n"), F.sum("b1").alias("g1"), F.sum("b2").alias("g2")).withColumns({"level": zero, "z1": zero, "z2": zero})
    for members, found in (("BAA", 1), ("BBA", 0), ("XYZ", 0), ("AAA", 0)):
        events = spark.createDataFrame([(1, a) for a in members], "group_id int, activity string")
        assert matching.match_any_order(groups, fixture_model.rows, fixture_model.nodes, events=events).count() == found


def test_hot_cases_of_several_sets(make_log):
    """A round folds only what is in it: sets and hot cases that are not there must not be waited for."""
    draw = random.Random(3)
    rows = [(f"c{i % 9 if i % 3 else 0}", draw.choice("ABC"), float(i // 4 + 100 - (draw.randrange(9) if i % 5 == 0 else 0)), i) for i in range(260)]
    log, model = make_log(rows), Model(random_log(make_log, 58, late=0))
    sets = [Params(order="ngrams", alpha=0.3), Params(alpha=0.3), Params(order="greedy", alpha=0.3)]
    columns = ["setting", "arrival_seq", "cost", "n_states", "open_events", "flag", "replayed", "complete_cost"]
    whole, cut = ([tuple(r) for r in check(log, model, sets, limit=n).select(*columns).orderBy("setting", "arrival_seq").collect()] for n in (None, 50))
    assert whole == cut and len(whole) == 3 * len(rows)
    for i, p in enumerate(sets):
        assert [r[1:] for r in whole if r[0] == i] == [tuple(r) for r in check(log, model, p).select(*columns[1:]).orderBy("arrival_seq").collect()]


def test_grid_is_its_single_runs(make_log):
    """All logs in one run against one run per log and algorithm."""
    logs, model = {s: random_log(make_log, n, cases=12, late=0.5) for s, n in (("00", 8), ("50", 9))}, Model(random_log(make_log, 58, late=0))
    algorithms = {n: Params(order=p.order, adaptable=p.adaptable, event_time_aware=p.event_time_aware, alpha=0.3) for n, p in experiments.ALGORITHMS.items()}
    got = experiments.run_grid(logs, model, algorithms, "d").collect()
    for swap, log in logs.items():
        for name, p in algorithms.items():
            alone = {(r.arrival_seq, r.cost, r.flag, r.n_states) for r in check(log, model, p).collect()}
            assert alone == {(r.arrival_seq, r.cost, r.flag, r.n_states) for r in got if r.swap == swap and r.algo == name}


@pytest.mark.parametrize("alpha,block,fan,keys", [(0.0, 7, 30, []), (0.005, 1024, 512, []), (0.3, 7, 3, []), (0.3, 7, 2, ["case_id"]), (0.97, 300, 512, []), (1.0, 50, 512, [])])
def test_average_in_blocks(spark, alpha, block, fan, keys):
    """Blocks and levels of any size give the sequence; null flags, null keys and blocks without flags among them."""
    draw, rows = random.Random(12), []
    for i in range(160):
        rows.append((draw.choice(["a", "a", "a", "b", None]), i * 5, None if 40 < i < 70 or draw.random() < 0.2 else int(draw.random() < 0.4)))
    log = spark.createDataFrame(rows, "case_id string, arrival_seq bigint, flag int")
    m, want = {}, {}
    for case, i, flag in rows:
        k = case if keys else 0
        if flag is not None:
            m[k] = max(0.3, alpha * flag + (1 - alpha) * m.get(k, 0.3))
        want[i] = m.get(k, 0.3)
    for limit in (None, 30):
        out = disorder.ewma_multiplier(log, alpha, 0.3, limit, keys, block, fan)
        assert out.columns == ["case_id", "arrival_seq", "flag", "multiplier"]
        assert {r["arrival_seq"]: r["multiplier"] for r in out.collect()} == pytest.approx(want, abs=1e-12)
    assert "Arrow" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_average_of_nothing(spark):
    log = spark.createDataFrame([], "case_id string, arrival_seq bigint, flag int")
    for keys in ([], ["case_id"]):
        assert disorder.ewma_multiplier(log, 0.1, 0.3, None, keys).collect() == []
