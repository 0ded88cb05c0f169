"""Batch checker: the per-case fold over a whole log."""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass, replace
from functools import cached_property, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import step, tree
from tracefold.operators import disorder
from tracefold.operators.hot_fold import HOT_EVENTS, RESULT, RESULT_DDL, fold_hot, hot_cases
from tracefold.operators.hotkeys import position
from tracefold.operators.model import BY_TIME, NODE, PARENT, leaf_visits, ngrams, node_table, trace_rows
from tracefold.operators.ordering import best_pattern_per_bag
from tracefold.params import Params
from tracefold.session import shared_dir, with_fields, write_through
from tracefold.sources.messages import usable

MAX_BROADCAST_NODES = 1_000_000
MAX_ARRAY_NODES = 40_000_000  # about 20 bytes a node in each worker process
MAX_BROADCAST_PATTERNS = 1_000_000
MAX_LABELS = 1_000_000
BUCKET_NODES = 50_000
CACHE_ROWS = 50_000_000  # larger model logs are read again instead of being kept
EVENTS_PER_TASK = 250_000
PLACE = ["_block", "_at"]
MOVES = "array<struct<log:string,model:string,cost:int>>"


@dataclass
class Model:
    """The model tables of a log and their form for tasks."""

    log: DataFrame
    order: list[str] | None = None
    max_pattern: int = 10
    max_nodes: int = MAX_BROADCAST_NODES
    max_patterns: int = MAX_BROADCAST_PATTERNS
    max_array: int = MAX_ARRAY_NODES

    @cached_property
    def rows(self) -> DataFrame:
        rows = trace_rows(self.log, self.order or BY_TIME)
        return rows.persist() if self.log.count() <= CACHE_ROWS else rows

    @cached_property
    def nodes(self) -> DataFrame:
        return node_table(self.rows).persist()

    @cached_property
    def patterns(self) -> DataFrame:
        return ngrams(self.log, self.max_pattern, self.order or BY_TIME)

    @cached_property
    def avg_len(self) -> int:
        row = leaf_visits(self.rows, self.nodes).agg(F.floor(F.sum("level") / F.count(F.lit(1))).alias("a")).first()
        if row["a"] is None:
            raise ValueError("the model log has no traces")
        return row["a"]

    def data(self, with_patterns: bool) -> dict:
        """What a task needs.  Up to ``max_nodes`` the tree itself; beyond, the place of its written table: of numbered nodes, which a task reads into arrays,
        or beyond ``max_array`` of buckets that it reads as needed."""
        size = self.nodes.agg(F.count(F.lit(1)), F.min(F.col("min_to_end") + F.col("level")), F.max(F.col("max_to_end") + F.col("level"))).first()
        labels = [r["symbol"] for r in self.nodes.select("symbol").distinct().limit(MAX_LABELS + 1).collect()]
        if len(labels) > MAX_LABELS:
            raise ValueError(f"more than {MAX_LABELS} different activities")
        labels.sort()
        bags = self._bags(labels) if with_patterns else {}
        if size[0] <= self.max_nodes:
            pdf = self.nodes.select("level", "z1", "z2", "p_z1", "p_z2", "symbol", "first_trace", "min_to_end", "max_to_end").toPandas()
            return tree.pack(pdf, labels, self.avg_len, bags, tuple(size[1:]))
        if size[0] <= self.max_array:
            return {"path": self._numbered, "size": size[0] + 1, "labels": labels, "avg_len": self.avg_len, "patterns": bags, "root": tuple(size[1:])}
        path = f"{shared_dir(self.log.sparkSession)}/model-{uuid.uuid4().hex}"
        buckets = max(1, size[0] // BUCKET_NODES)
        kids = self.nodes.select(*tree.BUCKET_COLUMNS)
        kids = kids.withColumn("bucket", F.pmod("p_z1", F.lit(buckets)))
        kids.repartition("bucket").write.partitionBy("bucket").parquet(path)
        return {"path": path, "buckets": buckets, "labels": labels, "avg_len": self.avg_len, "patterns": bags, "root": tuple(size[1:])}

    @cached_property
    def _numbered(self) -> str:
        """Folder with the nodes for ``ArrayTree``, numbered by level and first trace as ``tree.pack`` does."""
        path = f"{shared_dir(self.log.sparkSession)}/numbered-{uuid.uuid4().hex}"
        nodes = self.nodes.select(*NODE, *PARENT, "symbol", "first_trace", "min_to_end", "max_to_end")
        nodes = write_through(position(nodes, [], ["level", "first_trace"], "n"), "nodes")
        above = nodes.select(*[F.col(c).alias(p) for c, p in zip(NODE, PARENT)], F.col("n").alias("p"))
        siblings = Window.partitionBy(*PARENT).orderBy("symbol")
        kids = nodes.join(above, PARENT, "left").withColumn("p", F.coalesce("p", F.lit(0)))  # the root is no row
        kids = kids.withColumn("first", F.row_number().over(siblings) == 1).withColumn("next", F.coalesce(F.lead("n").over(siblings), F.lit(0)))
        kids.select(*tree.ARRAY_COLUMNS, "z1", "z2").write.parquet(path)
        return path

    def _bags(self, labels: list[str]) -> dict:
        """Most frequent order per bag of activities: itself, or beyond the limit the place of its written table."""
        best = best_pattern_per_bag(self.patterns).select("bag", "pattern").persist()
        size = best.count()
        if size > self.max_patterns:
            path, buckets = f"{shared_dir(self.log.sparkSession)}/patterns-{uuid.uuid4().hex}", max(1, size // BUCKET_NODES)
            text = F.array_join("bag", tree.SEPARATOR)
            rows = best.select(text.alias("bag"), "pattern", (F.crc32(text.cast("binary")) % buckets).alias("bucket"))
            rows.repartition("bucket").write.partitionBy("bucket").parquet(path)
            bags = {"path": path, "buckets": buckets}
        else:
            number = {a: i for i, a in enumerate(labels)}
            rows = best.select("pattern").collect()
            bags = {tuple(sorted(number[a] for a in r[0])): tuple(number[a] for a in r[0]) for r in rows}
        best.unpersist()
        return bags

    def ship(self, with_patterns: bool):
        """Broadcast for tasks, built once per kind."""
        kept = self.__dict__.setdefault("_shipped", {})
        if with_patterns not in kept:
            kept[with_patterns] = self.log.sparkSession.sparkContext.broadcast(self.data(with_patterns))
        return kept[with_patterns]

    def publish(self, with_patterns: bool) -> str:
        """Folder with the data for tasks, for places that cannot take broadcasts (stateful streams)."""
        spark = self.log.sparkSession
        path = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
        row = [(bytearray(pickle.dumps(self.data(with_patterns))),)]
        spark.createDataFrame(row, "data binary").coalesce(1).write.parquet(path)
        return path


def check(log: DataFrame, model: Model, params: Params | list[Params] = Params(), alignments: bool = False,
          ewma_keys: list[str] | None = None, limit: int | None = None, near: list[str] | None = None) -> DataFrame:
    """One row per usable event (``messages.rejected`` has the others): the input columns plus the columns of RESULT.

    With several parameter sets all run in the same job; ``setting`` is the index of the set.  ``alignments`` adds the moves
    of the reported alignment, and of the complete one if the case ended there: both as long as the case so far, so only
    for logs of short cases.  The adaptive multiplier
    follows the whole log in delivery order, or each of ``ewma_keys``.  Several sets share the work of cases that go alike; cases that may do so
    have the same values in ``near``.
    """
    many = isinstance(params, list)
    sets = params if many else [params]
    log = usable(log)
    shipped = model.ship(any(p.order == "ngrams" for p in sets))
    plan = FoldPlan.of(log, limit)
    if many:
        ready = multipliers(log, model, sets, plan, ewma_keys)
        out = fold(_tagged(ready, sets), sets, shipped, plan, True) if alignments else fold_sets(ready, sets, shipped, plan, near)
        return out.drop("multiplier", *PLACE)
    tagged, p = log.withColumn("setting", F.lit(0)), params
    if not p.adapts:
        ready = tagged.withColumn("multiplier", F.lit(float(p.multiplier)))
    else:
        flagged = disorder.first_flags(tagged, p.order, limit).withColumnRenamed("flag", "used")
        if _needs_fold(p):
            settled = _settle(flagged, p, sets, model, plan, ewma_keys, limit).drop("used")
            if not alignments:
                return settled.drop("multiplier", "setting")
            ready = settled.drop(*RESULT)
        else:
            ready = _multiplier(flagged, p, ewma_keys, limit).drop("used")
    return fold(ready, sets, shipped, plan, alignments).drop("multiplier", "setting")


def _needs_fold(p: Params) -> bool:
    """Whether flags depend on the fold."""
    return p.order != "none" or p.min_decay < 2


def _own(i: int) -> str:
    return f"_m{i}"


def _tagged(ready: DataFrame, sets: list[Params]) -> DataFrame:
    """The rows of ``multipliers`` once per set, with ``setting`` and ``multiplier``."""
    columns = [c for c in ready.columns if c not in map(_own, range(len(sets)))]
    own = lambda i: F.col(_own(i)) if sets[i].adapts else F.lit(float(sets[i].multiplier))
    return reduce(DataFrame.unionByName, [ready.select(*columns, F.lit(i).alias("setting"), own(i).alias("multiplier")) for i in range(len(sets))])


def multipliers(log: DataFrame, model: Model, sets: list[Params], plan: "FoldPlan", keys: list[str] | None) -> DataFrame:
    """The log with a column ``_m{i}`` for each adaptive set, and the place of each row in the delivery order."""
    adaptive = {i: (p.alpha, p.multiplier, p.order == "none") for i, p in enumerate(sets) if p.adapts}
    if not adaptive:
        return log
    tasks = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan.total // EVENTS_PER_TASK)
    # without long cases no window needs cuts
    delivery = disorder.Delivery(log, keys, tasks, plan.limit if plan.hot else max(plan.total, 1))
    used, open_ = None, [i for i in adaptive if _needs_fold(sets[i])]
    if open_:
        tied = _tied_rows(delivery.rows, any(sets[i].min_decay < 2 for i in open_))
        used = _settle_ties(tied, sets, open_, model, plan, delivery, {i: adaptive[i] for i in open_})
    found = delivery.averages(adaptive, used)
    rows = delivery.rows.repartition(tasks, "_block").join(found.repartition(tasks, "_block").hint("shuffle_hash"), "_block")
    return rows.select(*log.columns, *PLACE, *[F.element_at(_own(i), F.col("_at") + 1).alias(_own(i)) for i in adaptive])


def _tied_rows(rows: DataFrame, every: bool) -> DataFrame:
    """The cases whose flags depend on the fold: those with equal timestamps, or every one."""
    if every:
        return rows
    same = rows.groupBy("case_id", F.unix_millis("event_time").alias("_ms")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return write_through(rows.join(same.select("case_id").distinct(), "case_id", "left_semi"), "tied")


def retained(log: DataFrame, model: Model, p: Params = Params(), limit: int | None = None) -> DataFrame:
    """The states that are kept after the last event of each case, one row each: case_id, open_events, the node's identity, base_cost, postfix (the open
    events) and complete_cost of the case.  As many rows as states are in memory; a case is read by one task, whatever its length."""
    shipped = model.ship(p.order == "ngrams")
    log = usable(log)
    tagged = log.select("case_id", "activity", "event_time", "arrival_seq", F.lit(0).alias("setting"))
    if not p.adapts:
        ready = tagged.withColumn("multiplier", F.lit(float(p.multiplier)))
    else:
        flagged = disorder.first_flags(tagged, p.order, limit).withColumnRenamed("flag", "used")
        if not _needs_fold(p):
            ready = _multiplier(flagged, p, None, limit).drop("used")
        else:
            ready = _settle(flagged, p, [p], model, FoldPlan.of(log, limit), None, limit).select(*tagged.columns, "multiplier")
    n = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), log.count() // EVENTS_PER_TASK)
    ranged = ready.repartition(n, "case_id").sortWithinPartitions("case_id", "arrival_seq")
    schema = "case_id string, open_events int, level long, z1 long, z2 long, base_cost int, postfix array<string>, complete_cost int"
    return ranged.mapInArrow(lambda it: _retained(it, shipped, p), schema)


def _retained(batches, shipped, p: Params):
    model = tree.local_tree(shipped)
    number = model.number
    kind = pa.schema([("case_id", pa.string()), ("open_events", pa.int32()), *[(c, pa.int64()) for c in ("level", "z1", "z2")],
                      ("base_cost", pa.int32()), ("postfix", pa.list_(pa.string())), ("complete_cost", pa.int32())])
    now, case, out = None, None, []

    def leave() -> None:
        if now is not None:
            ended = step.complete_cost(model, case)
            for k, cost, _, nodes in case.gens:
                events = [model.label(s) for s in case.tail[len(case.tail) - k :]]
                out.extend((now, k, *model.identity(n), cost, events, ended) for n in nodes)

    for batch in batches:
        cols = (batch.column(c).to_pylist() for c in ("case_id", "activity", "multiplier"))
        for case_id, activity, mult, ts in zip(*cols, step.millis(batch.column("event_time"))):
            if case_id != now:
                leave()
                now, case = case_id, step.Case(p.multiplier)
                model.rest()
            step.observe(model, p, case, number.get(activity, activity), ts, mult)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), kind)], schema=kind)
            out.clear()
    leave()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), kind)], schema=kind)


def _multiplier(flagged: DataFrame, p: Params, keys, limit) -> DataFrame:
    return disorder.ewma_multiplier(flagged.withColumn("flag", F.col("used")), p.alpha, p.multiplier, limit, keys).drop("flag")


def _lives(p: Params, avg_len: int, multiplier: str) -> Column:
    """Equal for two multipliers exactly if every state lives equally long with both (``step.life``): no life falls as the multiplier grows, so their sum tells."""
    if not p.discounted:
        return F.lit(0)
    shortest = F.lit(p.min_decay).cast("bigint")
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(avg_len, 1))), F.lit(0).cast("bigint"), lambda n, left: n + F.greatest(F.floor(left * F.col(multiplier) + 0.5), shortest))


def _settle(flagged: DataFrame, p: Params, sets, model: Model, plan, keys, limit) -> DataFrame:
    """Results of an adaptive run whose flags depend on the fold.

    The flag of a tie depends on the order chosen for it, which depends on the multiplier so far.  The earliest wrong flag
    of a round is right in the next, so this ends; usually after one or two rounds.  The fold of a case reads its events and the lives that the multipliers
    give only, so a later round folds the cases in which a life changed and keeps the rows of the others, with their new multipliers.
    """
    shipped = model.ship(any(q.order == "ngrams" for q in sets))
    result = write_through(fold(_multiplier(flagged, p, keys, limit), sets, shipped, plan), "round")
    while not result.filter("not (flag <=> used)").isEmpty():
        again = result.drop("used").withColumnsRenamed({"flag": "used", "multiplier": "_was"})
        again = write_through(_multiplier(again, p, keys, limit), "flags")
        moved = write_through(again.filter(_lives(p, model.avg_len, "multiplier") != _lives(p, model.avg_len, "_was")).select("case_id").distinct(), "moved")
        kept = again.join(moved, "case_id", "left_anti").withColumn("flag", F.col("used")).select(*result.columns)
        folded = fold(again.join(moved, "case_id", "left_semi").drop("_was", *RESULT), sets, shipped, plan)
        result = write_through(kept.unionByName(folded), "round")
    return result


def _settle_ties(tied: DataFrame, sets: list[Params], which: list[int], model: Model, plan, delivery: disorder.Delivery, adaptive: dict) -> DataFrame:
    """Flags of the rows of ``tied`` under the sets of ``which``, whose flags depend on the fold: setting, _block, _at, used.

    As in ``_settle``; other cases have their flags from the start, so only these are folded.
    """
    shipped = model.ship(any(q.order == "ngrams" for q in sets))
    plan, place = replace(plan, total=tied.count()), ["setting", *PLACE]

    def averaged(rows: DataFrame) -> DataFrame:
        found = delivery.averages(adaptive, rows.select(*place, "used"))
        mine = F.coalesce(*[F.when(F.col("setting") == i, F.element_at(_own(i), F.col("_at") + 1)) for i in which])
        joined = rows.join(found, "_block").withColumn("multiplier", mine)
        return joined.drop(*map(_own, which))

    start = reduce(DataFrame.unionByName, [tied.withColumn("setting", F.lit(i)).withColumn("used", delivery.flag(sets[i].order)) for i in which])
    kept = [c for c in start.columns if c not in ("_code", "_codes")]
    result = write_through(fold(averaged(start.select(*kept)), sets, shipped, plan), "round")
    while not result.filter("not (flag <=> used)").isEmpty():
        again = result.drop("used").withColumnsRenamed({"flag": "used", "multiplier": "_was"})
        again = write_through(averaged(again), "flags")
        lives = lambda m: F.coalesce(*[F.when(F.col("setting") == i, _lives(sets[i], model.avg_len, m)) for i in which])
        changed = lives("multiplier") != lives("_was")
        moved = write_through(again.filter(changed).select("setting", "case_id").distinct(), "moved")
        same = again.join(moved, ["setting", "case_id"], "left_anti").withColumn("flag", F.col("used")).select(*result.columns)
        folded = fold(again.join(moved, ["setting", "case_id"], "left_semi").drop("_was", *RESULT), sets, shipped, plan)
        result = write_through(same.unionByName(folded), "round")
    return result.select(*place, "used")


@dataclass(frozen=True)
class FoldPlan:
    """What is known about a log before the fold: its size and its cases that are too long for one task."""

    total: int
    limit: int
    hot: tuple

    @classmethod
    def of(cls, log: DataFrame, limit: int | None) -> "FoldPlan":
        limit, total = limit or HOT_EVENTS, log.count()
        return cls(total, limit, tuple(hot_cases(log, total, limit)))


def fold(log: DataFrame, sets: list[Params], shipped, plan: FoldPlan, alignments: bool = False) -> DataFrame:
    """The fold itself: cases are spread by hash, sorted by arrival, and read once per task with one case in memory.

    Hot cases are cut into blocks (not with alignments, which grow with the case anyway).
    """
    total = plan.total * len(sets)  # an upper bound: not every set has to be in this log
    if not plan.hot or alignments:
        return fold_plain(log, total, sets, shipped, alignments)
    cases = F.broadcast(log.sparkSession.createDataFrame([(c,) for c, _ in plan.hot], "case_id string"))
    rest = fold_plain(log.join(cases, "case_id", "left_anti"), total, sets, shipped)
    long = log.join(cases, "case_id", "left_semi")
    # those in this log, which need not have every set and every case; at most MAX_HOT_CASES per set
    hot = [(r["setting"], r["case_id"], r["n"]) for r in long.groupBy("setting", "case_id").agg(F.count(F.lit(1)).alias("n")).collect()]
    return rest.unionByName(_fold_hot(long, hot, sets, shipped, plan.limit)) if hot else rest


def _fold_hot(long: DataFrame, hot: list, sets: list[Params], shipped, limit: int) -> DataFrame:
    """``fold_hot``, whose blocks are others than those of the delivery."""
    out = fold_hot(long.withColumnsRenamed({c: f"{c}_delivered" for c in PLACE}), hot, sets, shipped, limit)
    return out.withColumnsRenamed({f"{c}_delivered": c for c in PLACE})


def _in_delivery(log: DataFrame) -> list[str]:
    """Columns that order the events of a case; rows that come twice stay in the order that their multipliers were taken in."""
    return ["arrival_seq", *[c for c in PLACE if c in log.columns]]


def fold_plain(log: DataFrame, total: int, sets: list[Params], shipped, alignments: bool = False) -> DataFrame:
    n = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // EVENTS_PER_TASK)
    ranged = log.repartition(n, "setting", "case_id").sortWithinPartitions("setting", "case_id", *_in_delivery(log))
    schema = with_fields(log.schema, RESULT_DDL + (f", alignment {MOVES}, complete_alignment {MOVES}" if alignments else ""))
    return ranged.mapInArrow(lambda it: _fold(it, shipped, sets, alignments), schema)


def fold_sets(log: DataFrame, sets: list[Params], shipped, plan: FoldPlan, near: list[str] | None = None) -> DataFrame:
    """The fold of the rows of ``multipliers`` under all sets, which come out as ``setting``; hot cases by themselves."""
    n = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan.total * len(sets) // EVENTS_PER_TASK)
    near = near or ["case_id"]
    rest = log
    if plan.hot:
        cases = F.broadcast(log.sparkSession.createDataFrame([(c,) for c, _ in plan.hot], "case_id string"))
        rest = log.join(cases, "case_id", "left_anti")
    ranged = rest.repartition(n, *near).sortWithinPartitions(*dict.fromkeys([*near, "case_id", *_in_delivery(log)]))
    columns = [c for c in log.columns if c not in map(_own, range(len(sets)))]
    schema = with_fields(log.select(*columns).schema, f"setting int, {RESULT_DDL}")
    out = ranged.mapInArrow(lambda it: _fold_sets(it, shipped, sets), schema)
    if not plan.hot:
        return out
    long = _tagged(log.join(cases, "case_id", "left_semi"), sets)
    hot = [(i, c, n) for i in range(len(sets)) for c, n in plan.hot]
    return out.unionByName(_fold_hot(long, hot, sets, shipped, plan.limit).select(*out.columns))


def _fold_sets(batches, shipped, sets: list[Params]):
    model = tree.local_tree(shipped)
    number, runs = model.number, step.Runs(model, sets)
    now, case, n = None, None, len(sets)
    for batch in batches:
        out: list = []
        own = [batch.column(_own(i)).to_pylist() if p.adapts else repeat(float(p.multiplier)) for i, p in enumerate(sets)]
        cols = (batch.column(c).to_pylist() for c in ("case_id", "activity"))
        for case_id, activity, ts, mults in zip(*cols, step.millis(batch.column("event_time")), zip(*own)):
            if case_id != now:
                now, case = case_id, runs.begin()
            rows = [None] * n
            case = runs.observe(case, number.get(activity, activity), ts, mults, rows)
            out.append(rows)
        kept = batch.select([c for c in batch.schema.names if c not in map(_own, range(n))])
        for i, rows in enumerate(zip(*out)):
            result = kept.append_column("setting", pa.array(np.full(len(rows), i, np.int32)))
            for name, values in zip(RESULT, zip(*rows)):
                result = result.append_column(name, pa.array(values, pa.int32()))
            yield result


def _fold(batches, shipped, sets: list[Params], alignments: bool):
    model = tree.local_tree(shipped)
    number = model.number
    now, case, p = None, None, None
    for batch in batches:
        cols = (batch.column(c).to_pylist() for c in ("setting", "case_id", "activity", "multiplier"))
        out, moves, ended = [], step.Moves(model), step.Moves(model)
        for setting, case_id, activity, mult, ts in zip(*cols, step.millis(batch.column("event_time"))):
            if (setting, case_id) != now:
                now, p = (setting, case_id), sets[setting]
                case = step.Case(p.multiplier)
                model.rest()
            flag, redone = step.observe(model, p, case, number.get(activity, activity), ts, mult, alignments)
            out.append((case.cost, step.states(case), case.gens[0][0], flag, redone, step.complete_cost(model, case)))
            if alignments:
                step.report(model, case, moves, ended)
        result = batch
        for name, values in zip(RESULT, zip(*out)):
            result = result.append_column(name, pa.array(values, pa.int32()))
        if alignments:
            result = result.append_column("alignment", moves.array()).append_column("complete_alignment", ended.array())
        yield result
