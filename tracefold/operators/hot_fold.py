"""The fold for cases that are too long for one task.

A case is a sequence, but what it carries from one event to the next is small and soon forgets.  Hot cases are cut into
blocks of consecutive events.  A block is run from a guess of the state at its start: the last known
state, warmed up with the events just before the block.  The guess is then compared with the state in which
the block before really ended; blocks whose guess was right are done, from the first wrong one the next round starts with
the true state, and fewer blocks are tried at once.  Every round finishes at least one block per case and nothing unverified is returned, so the result is
exact whatever the guesses are worth.  Costs inside a block count from its start; the sums of the earlier blocks are
added at the end.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions import step, tree
from tracefold.operators.hotkeys import position
from tracefold.params import Params
from tracefold.session import with_fields, write_through

HOT_EVENTS = 2_000_000
MAX_HOT_CASES = 50_000
MAX_BLOCKS = 100_000
WARM_UP = 512
KEY = ["setting", "case_id"]
RESULT = ["cost", "n_states", "open_events", "flag", "replayed", "complete_cost"]
RESULT_DDL = ", ".join(f"{c} int" for c in RESULT)


def hot_cases(log: DataFrame, total: int, limit: int) -> list[tuple[str, int]]:
    """Cases with more events than the limit and their numbers of events: at most MAX_HOT_CASES."""
    if total <= limit:
        return []
    counts = log.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(limit, total // MAX_HOT_CASES))
    return [(r["case_id"], r["n"]) for r in counts.collect()]


def fold_hot(log: DataFrame, hot: list[tuple[int, str, int]], sets: list[Params], shipped, limit: int) -> DataFrame:
    """``hot``: (setting, case, number of events)."""
    spark = log.sparkSession
    size = max(limit, sum(n for _, _, n in hot) // MAX_BLOCKS)
    warm = WARM_UP
    blocks = {(i, c): -(-n // size) for i, c, n in hot}
    placed = position(log, KEY, ["arrival_seq"], "_pos", limit)
    block = F.floor((F.col("_pos") - 1) / size).cast("int")
    feeds_next = (F.col("_pos") - 1) % size >= size - min(warm, size)
    homes = F.when(feeds_next, F.array(block, block + 1)).otherwise(F.array(block))
    placed = placed.select("*", F.explode(homes).alias("_block")).withColumn("_warm", F.col("_block") > block)
    placed = write_through(placed, "hot")
    known = {k: {"block": 0, "state": None, "before": 0} for k in blocks}
    width, done, rounds = 1, [], []
    while any(known[k]["block"] < blocks[k] for k in known):
        plan = [
            (*k, b, json.dumps(known[k]["state"]), b == known[k]["block"])
            for k in known
            for b in range(known[k]["block"], min(known[k]["block"] + width, blocks[k]))
        ]
        todo = spark.createDataFrame(plan, "setting int, case_id string, _block int, _state string, _exact boolean")
        rows = placed.join(F.broadcast(todo), [*KEY, "_block"])  # one row per block
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(plan))
        ranged = rows.repartition(n, *KEY, "_block").sortWithinPartitions(*KEY, "_block", "_pos")
        keep = [c for c in placed.columns if c not in ("_pos", "_warm")]
        schema = with_fields(rows.select(*keep).schema, f"{RESULT_DDL}, _from string, _to string, _sum int")
        result = write_through(ranged.mapInArrow(lambda it, keep=keep: _run(it, keep, shipped, sets), schema), "blocks")
        ends = {(*(r[c] for c in KEY), r["_block"]): r for r in result.filter("_to is not null").select(*KEY, "_block", "_from", "_to", "_sum").collect()}
        right = 0
        for k, at in known.items():
            exact = True  # the first block started from the true state
            while (end := ends.get((*k, at["block"]))) is not None:
                if not exact and json.loads(end["_from"]) != at["state"]:
                    break
                exact = False
                done.append((len(rounds), *k, at["block"], at["before"]))
                at["state"], at["before"], at["block"] = json.loads(end["_to"]), at["before"] + end["_sum"], at["block"] + 1
                right += 1
        rounds.append(result.drop("_from", "_to", "_sum"))
        width = MAX_BLOCKS if not rounds[1:] else max(1, width // 2) if 2 * right < len(plan) else min(2 * width, MAX_BLOCKS)
    return _assemble(spark, rounds, done)


def _assemble(spark, rounds: list[DataFrame], done: list[tuple]) -> DataFrame:
    out = None
    for i, result in enumerate(rounds):
        mine = [d[1:] for d in done if d[0] == i]
        good = spark.createDataFrame(mine, "setting int, case_id string, _block int, _before bigint")
        part = result.join(F.broadcast(good), [*KEY, "_block"])
        out = part if out is None else out.unionByName(part)
    for c in ("cost", "complete_cost"):
        out = out.withColumn(c, (F.col(c) + F.col("_before")).cast("int"))
    return out.drop("_block", "_before")


def relative(case: step.Case, model: tree.Tree) -> list:
    """The state with costs counted from its own, in one spelling; what two runs must share to go on alike."""
    size, cost, tail, times, gens, _ = case.dump(model)
    return [size, tail, times, [[k, c - cost, d, sorted(nodes)] for k, c, d, nodes in gens]]


def _restore(data: list, model: tree.Tree, p: Params) -> step.Case:
    size, tail, times, gens = data
    return step.Case.load([size, 0, tail, list(times), gens, p.multiplier], model)


def _guess(data: list | None, model: tree.Tree, p: Params, size: int) -> step.Case:
    """The last known state as if it held ``size`` events into the case; what it retains is replaced while warming up."""
    if data is None:
        return step.Case(p.multiplier)
    return _restore([size, *data[1:]], model, p)


def _run(batches, keep: list[str], shipped, sets: list[Params]):
    model = tree.local_tree(shipped)
    now = case = p = start = None
    held: list = []  # the last row of a block waits until the block is known to be over
    for batch in batches:
        names = ("setting", "case_id", "_block", "activity", "multiplier", "_pos", "_warm", "_state", "_exact")
        columns = [batch.column(c).to_pylist() for c in names]
        out, kept = [], []
        for i, (setting, case_id, block, activity, mult, pos, warm, state, exact, ts) in enumerate(
            zip(*columns, step.millis(batch.column("event_time")))
        ):
            key = (setting, case_id, block)
            if key != now:
                _close(out, held, case, start, model)
                now, p, start = key, sets[setting], None
                known = json.loads(state)
                if exact:
                    case = _restore(known, model, p) if known is not None else step.Case(p.multiplier)
                else:
                    case = _guess(known, model, p, pos - 1)
            if warm:
                if not exact:
                    step.observe(model, p, case, model.number.get(activity, activity), ts, mult)
                continue
            if start is None:
                start = relative(case, model) if case.gens is not None else []
                for gen in case.gens or []:
                    gen[1] -= case.cost
                case.cost = 0
            flag, redone = step.observe(model, p, case, model.number.get(activity, activity), ts, mult)
            values = (case.cost, step.states(case), case.gens[0][0], flag, redone, step.complete_cost(model, case))
            held = _swap(out, held, [batch, i, values, None, None, None])
        yield from _emit(out, keep)
    out = []
    _close(out, held, case, start, model)
    yield from _emit(out, keep)


def _swap(out: list, held: list, row: list) -> list:
    if held:
        out.append(held)
    return row


def _close(out: list, held: list, case, start, model) -> None:
    if held:
        held[3:] = [json.dumps(start), json.dumps(relative(case, model)), case.cost]
        out.append(held[:])
        held.clear()


def _emit(rows: list, keep: list[str]):
    """Rows back as batches: the input columns by index, the results beside them."""
    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] is rows[i][0]:
            j += 1
        source = rows[i][0].select(keep).take(pa.array([r[1] for r in rows[i:j]], pa.int64()))
        for name, values in zip(RESULT, zip(*(r[2] for r in rows[i:j]))):
            source = source.append_column(name, pa.array(values, pa.int32()))
        for name, c, kind in (("_from", 3, pa.string()), ("_to", 4, pa.string()), ("_sum", 5, pa.int32())):
            source = source.append_column(name, pa.array([r[c] for r in rows[i:j]], kind))
        yield source
        i = j
