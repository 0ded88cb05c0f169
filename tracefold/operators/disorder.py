"""Late events, the adaptive retention multiplier, and controlled disorder."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.operators.hotkeys import CHUNK, position, running, with_chunks
from tracefold.session import with_fields, write_through

# probability in percent -> largest distance of a swap (fixed values)
SWAP_SETTINGS = {"01": 1, "05": 5, "10": 7, "20": 10, "50": 20, "99": 99}

#: Rows of a block of the running average, maps that are composed at once, and a value below all others.
BLOCK, FAN, NONE = 1024, 512, -1e300


def late_flags(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Add ``seen_ms`` (highest event time of the case so far, null on its first event), ``late`` and ``late_or_tied``."""
    ms = F.unix_millis("event_time")
    out = running(log, ["case_id"], ["arrival_seq"], {"seen_ms": ("max", ms)}, limit, exclusive=True)
    return out.select("*", (ms < F.col("seen_ms")).alias("late"), (ms <= F.col("seen_ms")).alias("late_or_tied"))


def first_flags(log: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """Add ``flag``: 1 late, 0 in order, null for the first event of a case and, if ties are re-ordered, for a tie."""
    flags = late_flags(log, limit)
    flag = F.col("late").cast("int")
    if order != "none":
        flag = F.when(F.unix_millis("event_time") == F.col("seen_ms"), F.lit(None)).otherwise(flag)
    return flags.withColumn("flag", flag).drop("seen_ms", "late", "late_or_tied")


def ewma_multiplier(
    log: DataFrame, alpha: float, floor: float, limit: int | None = None, keys: list[str] | None = None, block: int = BLOCK, fan: int = FAN
) -> DataFrame:
    """Add ``multiplier``: m <- max(floor, alpha * flag + (1 - alpha) * m) in delivery order; null flags change nothing.

    One update is the map m -> max(a, b + c * m); such maps are closed under composition.  The log (or each of ``keys``, such as the case) is cut into
    blocks of ``block`` rows.  With k = 1 - alpha, s the sum of alpha * flag / k^j over the first j flags of a block, and g the maximum of floor / k^j - s so
    far, the value after them is k^j * (s + max(start, g)): two running windows.  ``_starts`` chains the maps of the blocks, ``fan`` at a time.
    """
    keys = keys or []
    k = max(1.0 - alpha, 1e-300)  # alpha 1 forgets all but the last flag
    block = max(1, min(block, int(-250 / math.log10(k)))) if k < 1 else block  # k^-block must be finite
    part = [*keys, "_block"]
    rows = position(log, keys, ["arrival_seq"], "_pos", limit).withColumn("_block", F.floor((F.col("_pos") - 1) / block).cast("bigint"))
    so_far = Window.partitionBy(*part).orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_j", F.count("flag").over(so_far)).withColumn("_back", F.pow(F.lit(k), -F.col("_j")))
    rows = rows.withColumn("_s", F.coalesce(F.sum(alpha * F.col("flag") * F.col("_back")).over(so_far), F.lit(0.0)))
    rows = rows.withColumn("_g", F.max(F.when(F.col("flag").isNotNull(), floor * F.col("_back") - F.col("_s"))).over(so_far))
    rows = write_through(rows, "averages")  # read twice: for the maps of the blocks and for the rows
    ends = rows.groupBy(*part).agg(F.max_by(F.struct("_j", "_s", "_g", "_back"), "_pos").alias("e")).select(*part, "e.*")
    maps = ends.select(
        *part, F.coalesce((F.col("_s") + F.col("_g")) / F.col("_back"), F.lit(NONE)).alias("a"), (F.col("_s") / F.col("_back")).alias("b"), (1 / F.col("_back")).alias("c")
    )
    out = _beside(rows, _starts(maps, keys, floor, fan), part)
    value = (F.col("_s") + F.greatest("_start", "_g")) / F.col("_back")
    return out.select(*log.columns, F.greatest(F.lit(floor), F.when(F.col("_j") == 0, F.col("_start")).otherwise(value)).alias("multiplier"))


def _starts(maps: DataFrame, keys: list[str], floor: float | Column, fan: int) -> DataFrame:
    """The value before each block, from the maps (a, b, c) of the blocks: arrays of at most ``fan`` maps, composed to one map each, and so on upwards."""
    maps = write_through(maps, "maps")
    blocks = (maps.agg(F.max("_block")).first()[0] or 0) + 1
    group = F.floor(F.col("_block") / fan).cast("bigint").alias("_group")
    some = maps.groupBy(*keys, group).agg(F.sort_array(F.collect_list(F.struct("_block", "a", "b", "c"))).alias("_maps"))
    if blocks <= fan:
        some = some.withColumn("_first", floor if isinstance(floor, Column) else F.lit(float(floor)))
    else:
        whole = f"aggregate(_maps, named_struct('a', {NONE}D, 'b', 0D, 'c', 1D), (s, t) -> named_struct('a', greatest(t.a, t.b + t.c * s.a), 'b', t.b + t.c * s.b, 'c', t.c * s.c))"
        above = some.select(*keys, F.col("_group").alias("_block"), F.expr(whole).alias("w")).select(*keys, "_block", "w.*")
        first = _starts(above, keys, floor, fan).withColumnsRenamed({"_block": "_group", "_start": "_first"})
        some = _beside(some, first, [*keys, "_group"])
    scan = """aggregate(_maps, named_struct('m', _first, 'out', CAST(array() AS array<struct<_block: bigint, _start: double>>)),
        (s, t) -> named_struct('m', greatest(t.a, t.b + t.c * s.m), 'out', concat(s.out, array(named_struct('_block', t._block, '_start', s.m)))), s -> s.out)"""
    return some.select(*keys, F.expr(f"inline({scan})"))


CODE_IN_ORDER, CODE_LATE, CODE_FIRST, CODE_TIE = range(4)


class Delivery:
    """A log in the order in which it was delivered (or each of ``keys``), for the multipliers of several settings.

    The log is dealt by ranges of ``arrival_seq`` and cut into blocks of at most ``BLOCK`` rows: ``rows`` has the block and the place in it beside each row,
    ``blocks`` a row per block with a code per row that tells its flag as far as no fold is needed.
    """

    def __init__(self, log: DataFrame, keys: list[str] | None, tasks: int, limit: int | None = None):
        self.keys, self.tasks = keys or [], tasks
        flags = late_flags(log, limit)
        code = F.when(F.col("seen_ms").isNull(), CODE_FIRST).when(F.col("late"), CODE_LATE).when(F.col("late_or_tied"), CODE_TIE).otherwise(CODE_IN_ORDER)
        coded = flags.withColumn("_code", code.cast("int")).drop("seen_ms", "late", "late_or_tied")
        order, keys, block = [*self.keys, "arrival_seq"], self.keys, BLOCK
        ranged = coded.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        schema = with_fields(coded.schema, "_task long, _n long, _at int, _codes binary")
        rows = write_through(ranged.mapInArrow(lambda it: _cut(it, keys, block), schema), "delivered")
        most = (rows.agg(F.max("_n")).first()[0] or 0) + 1
        self.columns = log.columns
        self.rows = rows.withColumn("_block", F.col("_task") * most + F.col("_n")).drop("_task", "_n")
        self.blocks = self.rows.filter("_codes IS NOT NULL").select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_block", "_codes")

    def flag(self, order: str) -> Column:
        """The flag of ``rows`` as ``first_flags`` has it."""
        code = F.col("_code")
        return F.when(code == CODE_LATE, 1).when(code == CODE_IN_ORDER, 0).when((code == CODE_TIE) & F.lit(order == "none"), 0)

    def averages(self, sets: dict[int, tuple], used: DataFrame | None = None, fan: int = FAN) -> DataFrame:
        """Per block an array ``_m{setting}`` with the multiplier after each of its rows.  ``sets``: by setting (alpha, floor, whether ties count as in order);
        ``used`` has other flags than those of the codes: setting, _block, _at, used."""
        names = [c for c in self.blocks.columns if c.startswith("_key")]
        kind = "array<struct<setting:int,_at:int,used:int>>"
        if used is None:
            blocks = self.blocks.withColumn("_used", F.lit(None).cast(kind))
        else:
            known = used.groupBy("_block").agg(F.collect_list(F.struct(F.col("setting").cast("int").alias("setting"), "_at", "used")).cast(kind).alias("_used"))
            blocks = self.blocks.join(known, "_block", "left")
        schema = with_fields(blocks.select(*names, "_block").schema, "setting int, a double, b double, c double")
        maps = blocks.mapInArrow(lambda it: _maps(it, names, sets), schema)
        floor = F.element_at(F.lit([float(sets[i][1]) if i in sets else 0.0 for i in range(max(sets) + 1)]), F.col("setting") + 1)
        starts = _starts(maps, ["setting", *names], floor, fan)
        starts = starts.groupBy("_block").agg(F.collect_list(F.struct("setting", "_start")).alias("_starts"))
        ready = blocks.join(starts, "_block").select("_block", "_codes", "_used", "_starts")
        return ready.mapInArrow(lambda it: _values(it, sets), "_block long, " + ", ".join(f"_m{i} array<double>" for i in sets))


def _cut(batches, keys: list[str], block: int):
    """Rows with task, block and place; the last row of a block has the codes of the whole block."""
    task, n, held = TaskContext.get().partitionId(), 0, None

    def placed(rows, number, at, codes):
        new = {"_task": np.full(len(rows), task), "_n": number, "_at": at.astype(np.int32)}
        for name, values in new.items():
            rows = rows.append_column(name, pa.array(values))
        return rows.append_column("_codes", pa.array(codes, pa.binary()))

    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not len(rows):
            continue
        ends = [len(rows)]
        if keys:  # where another key begins
            new = np.zeros(len(rows), bool)
            for k in keys:
                at = rows[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= at[1:] != at[:-1]
            ends = [*np.flatnonzero(new).tolist(), len(rows)]
        cuts, begin = [0], 0
        for end in ends:
            cuts += [*range(begin + block, end, block), end]
            begin = end
        held = rows.slice(cuts[-2]).combine_chunks().to_batches()[0]  # may go on in the next batch
        done, cuts = rows.slice(0, cuts[-2]), cuts[:-1]
        if len(done):
            yield from placed(done, *_numbered(done, cuts, n)).combine_chunks().to_batches()
            n += len(cuts) - 1
    if held is not None:
        done = pa.Table.from_batches([held])
        yield from placed(done, *_numbered(done, [0, len(done)], n)).combine_chunks().to_batches()


def _numbered(rows, cuts: list[int], n: int):
    codes = np.asarray(rows["_code"]).astype(np.uint8)
    sizes = np.diff(cuts)
    whole = [None] * len(codes)
    for a, b in zip(cuts, cuts[1:]):
        whole[b - 1] = codes[a:b].tobytes()
    return np.repeat(np.arange(n, n + len(sizes)), sizes), np.arange(len(codes)) - np.repeat(cuts[:-1], sizes), whole


def _flags(batch, sets: dict[int, tuple], many: int = 256):
    """Some blocks at a time, per setting: (index of the first, setting, flags in a row per block); a flag of nan changes nothing."""
    codes, used = batch.column("_codes").to_pylist(), batch.column("_used").to_pylist()
    for first in range(0, len(codes), many):
        some = codes[first : first + many]
        grid = np.full((len(some), max(map(len, some))), CODE_FIRST, np.uint8)
        for i, c in enumerate(some):
            grid[i, : len(c)] = np.frombuffer(c, np.uint8)
        for setting, (_, _, ties) in sets.items():
            flags = np.array([0.0, 1.0, np.nan, 0.0 if ties else np.nan])[grid]
            for i, known in enumerate(used[first : first + many]):
                for u in known or ():
                    if u["setting"] == setting:
                        flags[i, u["_at"]] = np.nan if u["used"] is None else u["used"]
            yield first, setting, flags, [len(c) for c in some]


def _maps(batches, names: list[str], sets: dict[int, tuple]):
    """The map of each block, m -> max(a, b + c * m)."""
    for batch in batches:
        for first, setting, flags, sizes in _flags(batch, sets):
            alpha, floor, _ = sets[setting]
            a, b, c = np.full(len(sizes), NONE), np.zeros(len(sizes)), np.ones(len(sizes))
            for flag in flags.T:
                on, f = ~np.isnan(flag), alpha * flag
                a = np.where(on, np.maximum(floor, f + (1 - alpha) * a), a)
                b, c = np.where(on, f + (1 - alpha) * b, b), np.where(on, (1 - alpha) * c, c)
            rows = batch.select([*names, "_block"]).slice(first, len(sizes))
            rows = rows.append_column("setting", pa.array(np.full(len(sizes), setting, np.int32)))
            for name, values in (("a", a), ("b", b), ("c", c)):
                rows = rows.append_column(name, pa.array(values))
            yield rows


def _values(batches, sets: dict[int, tuple]):
    """The multipliers themselves, from the value before each block."""
    for batch in batches:
        starts = [{s["setting"]: s["_start"] for s in row} for row in batch.column("_starts").to_pylist()]
        columns: list = []
        for first, setting, flags, sizes in _flags(batch, sets):
            alpha, floor, _ = sets[setting]
            m = np.array([s[setting] for s in starts[first : first + len(sizes)]])
            out = np.empty_like(flags)
            for j, flag in enumerate(flags.T):
                m = np.where(np.isnan(flag), m, np.maximum(floor, alpha * flag + (1 - alpha) * m))
                out[:, j] = m
            inside = np.arange(out.shape[1]) < np.array(sizes)[:, None]
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(out[inside])))
            if len(columns) == len(sets):
                yield pa.RecordBatch.from_arrays([batch.column("_block").slice(first, len(sizes)), *columns], names=["_block", *[f"_m{i}" for i in sets]])
                columns = []


def _beside(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of the one row of ``more`` that has their keys; null keys are keys too."""
    more = more.withColumnsRenamed({k: f"_is_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_is_{k}")) for k in keys])
    return rows.join(more, same, "left").drop(*[f"_is_{k}" for k in keys])


def replay_size(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Add ``replay``: how many events of the case arrived earlier and have a higher event time (nothing forgotten).

    Counted by merging levels within a case.  A cut case is counted in three exact parts: pairs in the
    same range of arrival, pairs in the same range of event time, and all other pairs from a table of range counts.
    """
    log = log.withColumn("_ts", F.unix_millis("event_time"))
    by_arrival, cut = with_chunks(log, ["case_id"], ["arrival_seq"], limit)
    if not cut:
        return _higher_before(log, ["case_id"], "_ts", "replay").drop("_ts")
    both, _ = with_chunks(by_arrival.withColumnRenamed(CHUNK, "_c"), ["case_id"], ["_ts"], limit)
    both = both.withColumnRenamed(CHUNK, "_b")
    # pairs with another range of event time: _b higher, earlier arrival
    within = _higher_before(both, ["case_id", "_c"], "_b", "_n1")
    same = _higher_before(within, ["case_id", "_b"], "_ts", "_n2")
    cells = both.groupBy("case_id", "_c", "_b").agg(F.count(F.lit(1)).alias("_k"))
    cells = cells.join(F.broadcast(cells.filter("_c > 0 or _b > 0").select("case_id").distinct()), "case_id", "left_semi")
    grid = _cells_before(cells)
    out = same.join(grid, ["case_id", "_c", "_b"], "left")
    total = F.col("_n1") + F.col("_n2") + F.coalesce(F.col("_n3"), F.lit(0))
    return out.withColumn("replay", total).drop("_ts", "_c", "_b", "_n1", "_n2", "_n3")


def _cells_before(cells: DataFrame) -> DataFrame:
    """Per cell (arrival range, time range) of a cut case: rows in earlier arrival and higher time ranges.

    Two running sums over the grid: up the time ranges within one arrival range, then along the arrival ranges.
    """
    times = cells.select("case_id", "_b").distinct()
    ranges = cells.select("case_id", "_c").distinct()
    full = ranges.join(times, "case_id").join(cells, ["case_id", "_c", "_b"], "left").fillna(0, ["_k"])
    up = Window.partitionBy("case_id", "_c").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("case_id", "_b").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("_h", F.coalesce(F.sum("_k").over(up), F.lit(0)))
    return full.withColumn("_n3", F.coalesce(F.sum("_h").over(along), F.lit(0))).select("case_id", "_c", "_b", "_n3")


def _higher_before(df: DataFrame, part: list[str], value: str, name: str) -> DataFrame:
    """Add the number of earlier rows (by arrival_seq) of the part with a higher value.

    As in a merge sort, one level per bit of the place in the part: of two rows there is exactly one level at which they are in one run, the earlier one in its
    left half.  So a row adds up, over the levels where it is in a right half, the higher values of the left half.  All levels share one exchange by ``part``.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartition(n, *part)
    spread = spread.withColumn("_place", F.row_number().over(Window.partitionBy(*part).orderBy("arrival_seq")) - 1)
    longest = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    total = F.lit(0).cast("bigint")
    out = spread.withColumn("_less", -F.col(value).cast("bigint"))
    for level in range(max(0, longest - 1).bit_length()):
        left = F.shiftright("_place", level) % 2 == 0
        higher = Window.partitionBy(*part, F.shiftright("_place", level + 1)).orderBy("_less").rangeBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(f"_h{level}", F.when(~left, F.count(F.when(left, 1)).over(higher)).otherwise(0))
        total = total + F.col(f"_h{level}")
    return out.withColumn(name, total).select(*df.columns, name)


def _draw(x: Column, salt: int) -> Column:
    """A number in [0, 2^31 - 2] from integer arithmetic only, so that any SQL engine can repeat it (fixed values)."""
    m = 2147483647
    u = ((x + salt) % m * 48271 + 11) % m
    v = (u * u + u) % m
    return (v * 16807 + salt) % m


def inject_disorder(
    log: DataFrame, settings: dict[str, int] = SWAP_SETTINGS, seed: int = 1, limit: int | None = None
) -> DataFrame:
    """The log once per setting (column ``setting``), with events of a case swapped in the delivery order.

    A setting is a probability in percent and the largest distance.  Each event proposes, with that probability, a partner
    at most that many places away in its case.  Of proposals that share an event only the one with the smallest draw
    counts, so an event moves at most once, no case is ever held in one place, and timestamps stay with their events.
    """
    rows = position(log, ["case_id"], ["arrival_seq"], "idx", limit)
    kinds = [(k, int(k) * 10_000, dist, seed * 1000 + i * 10) for i, (k, dist) in enumerate(settings.items())]
    each = F.array(*[F.struct(F.lit(k).alias("setting"), F.lit(p).alias("ppm"), F.lit(d).alias("dist"), F.lit(s).alias("salt")) for k, p, d, s in kinds])
    x, salt = F.col("arrival_seq"), F.col("k.salt")
    away = 1 + _draw(x, salt + 1) % F.col("k.dist")
    asks = (
        rows.withColumn("k", F.explode(each))
        .filter(_draw(x, salt + 3) % 1_000_000 < F.col("k.ppm"))
        .select(
            "k.setting", "case_id", F.col("idx").alias("i"), x.alias("i_seq"), _draw(x, salt + 4).alias("draw"),
            (F.col("idx") + F.when(_draw(x, salt + 2) % 2 == 0, -away).otherwise(away)).alias("j"),
        )
    )
    # the partner must exist; both ends must have no better proposal
    places = rows.select("case_id", F.col("idx").alias("j"), x.alias("j_seq"))
    asks = asks.join(places, ["case_id", "j"]).withColumn("rank", F.struct("draw", "i_seq"))
    ends = asks.select("setting", F.explode(F.array("i_seq", "j_seq")).alias("seq"), "rank")
    least = ends.groupBy("setting", "seq").agg(F.min("rank").alias("least"))
    won = asks.select("setting", "rank", F.explode(F.array(F.struct(F.col("i_seq").alias("a"), F.col("j_seq").alias("b")),
                                                           F.struct(F.col("j_seq").alias("a"), F.col("i_seq").alias("b")))).alias("m"))
    won = won.join(least, (won["setting"] == least["setting"]) & (F.col("m.a") == F.col("seq"))).select(
        won["setting"], "m.a", "m.b", "rank", (F.col("rank") == F.col("least")).alias("ok")
    )
    moves = won.groupBy("setting", "rank").agg(F.bool_and("ok").alias("both"), F.collect_list(F.struct("a", "b")).alias("m"))  # two rows
    moves = moves.filter("both").select("setting", F.inline("m")).withColumnsRenamed({"a": "arrival_seq", "b": "new_seq"})
    out = rows.select("*", F.explode(F.lit(list(settings))).alias("setting")).join(moves, ["setting", "arrival_seq"], "left")
    out = out.withColumn("arrival_seq", F.coalesce("new_seq", "arrival_seq"))
    return out.select("setting", *log.columns)
