"""Findings of the third round: columns of alignments, cuts of a long log, caches of the search."""

import random

from pyspark.sql import functions as F

from test_step import build_tree, random_traces
from tracefold.functions import step, tree
from tracefold.operators import hotkeys
from tracefold.params import Params


def test_alignments_as_columns_are_the_moves(monkeypatch):
    """without a dict per move, and the way to the nearest end is walked once per node."""
    rng = random.Random(5)
    model = build_tree(random_traces(rng, "ABCD", 30))
    moves, ended, pairs, ends, asked = step.Moves(model), step.Moves(model), [], [], set()
    for _ in range(20):
        case = step.Case(0.3)
        for t in range(6):
            a = rng.choice("ABCDX")
            step.observe(model, Params(), case, model.number.get(a, a), t - 2 * rng.randint(0, 1), 0.3, True)
            pairs.append(step.alignment(model, case))
            ends.append(step.complete_alignment(model, case))
            step.report(model, case, moves, ended)
            asked.add(step._nearest(model, case))
    for got, want in ((moves, pairs), (ended, ends)):
        assert [[(m["log"], m["model"], m["cost"]) for m in row] for row in got.array().to_pylist()] == [[(a, b, int(a is None or b is None)) for a, b in row] for row in want]
    assert any(a == "X" for row in pairs for a, _ in row)  # an activity that the model does not know
    assert set(model._endings) == asked
    monkeypatch.setattr(tree, "KEPT_MOVES", 1)
    model._endings.clear()
    for n in range(len(model.parent)):
        assert len(model.ending(n)) == model.to_end[n] and len(model._endings) <= 2


def test_the_whole_log_is_cut_without_a_look_at_every_cut(spark):
    """with no keys the place of a row among the cuts is searched by halves."""
    log = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("t"), (F.col("id") % 3).alias("u"))
    for order in (["t"], ["u", "t"]):
        marked, cut = hotkeys.with_chunks(log, [], order, 100)
        chunk = hotkeys.CHUNK
        sizes = [r["count"] for r in marked.groupBy(chunk).count().collect()]
        assert cut and len(sizes) > 50 and max(sizes) <= 200 and sum(sizes) == 5000
        ranges = sorted(tuple(r) for r in marked.groupBy(chunk).agg(F.min(F.struct(*order)), F.max(F.struct(*order))).collect())
        assert all(a[2] < b[1] for a, b in zip(ranges, ranges[1:]))  # growing in the order
        placed = hotkeys.position(log, [], order, "pos", 100).collect()
        assert [r["pos"] for r in sorted(placed, key=lambda r: [r[c] for c in order])] == list(range(1, 5001))


def test_all_rows_at_one_place_are_one_chunk(spark):
    marked, cut = hotkeys.with_chunks(spark.range(300).select(F.lit(4).alias("t")), [], ["t"], 100)
    assert cut and marked.select(hotkeys.CHUNK).distinct().count() == 1


def test_what_is_only_cached_stays_small():
    """F7, F8: a worker process keeps few children of a large model."""
    rng = random.Random(8)
    model = build_tree(["".join(rng.choice("ABCDEFGH") for _ in range(12)) for _ in range(3000)])
    assert len(model.parent) > 25_000
    for n in range(len(model.parent)):
        model.kids(n)
    assert len(model._kids) <= 20_000
