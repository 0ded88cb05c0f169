"""One case, one event: the incremental prefix alignment.

A case keeps *generations* of partial alignments.  All members of a generation were created by the same event; they have
seen the same number of events since (``k``, their open events are the last ``k`` of ``tail``), and cost, trace size
and remaining life are equal, so a generation is one record with a dict of its model nodes.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa

from tracefold.functions.ties import arrange
from tracefold.functions.tree import Tree
from tracefold.params import Params


class Case:
    __slots__ = ("size", "cost", "tail", "times", "gens", "mult")

    def __init__(self, mult: float):
        self.size = 0  # events in the newest generation's alignment
        self.cost = 0
        self.tail: list = []  # retained events in effective order
        self.times: list[int] = []
        self.gens: list[list] | None = None  # [k, cost, decay, {node: alignment}], oldest first
        self.mult = mult

    def dump(self, tree: Tree) -> list:
        """Plain values, for state stores and hand-over between tasks (without alignments)."""
        tail = [tree.label(s) for s in self.tail]
        gens = self.gens and [[k, c, d, [tree.key(n) for n in nodes]] for k, c, d, nodes in self.gens]
        return [self.size, self.cost, tail, self.times.copy(), gens, self.mult]

    @classmethod
    def load(cls, data: list, tree: Tree) -> "Case":
        case = cls(data[5])
        case.size, case.cost, tail, case.times, gens, _ = data
        case.tail = [tree.number.get(a, a) for a in tail]
        case.gens = gens and [[k, c, d, {tree.find(n): None for n in nodes}] for k, c, d, nodes in gens]
        return case


def life(p: Params, avg_len: int, size: int, mult: float) -> int:
    """For how many further events a state is kept."""
    if not p.discounted:
        return p.min_decay
    return max(math.floor((avg_len - size) * mult + 0.5), p.min_decay)


def observe(tree: Tree, p: Params, case: Case, sym: int, ts: int, mult: float | None, keep: bool = False):
    """Take one event; returns (late flag or None, number of events replayed).

    ``mult`` is the retention multiplier at this event; None adapts the case's own one.  ``keep`` builds alignments.
    """
    flag, redo, back = None, [(sym, ts)], 0
    if case.gens is not None and p.event_time_aware and case.times:
        flag = 0
        newest = case.times[-1]
        if ts < newest or (ts == newest and p.order != "none"):
            flag = 1
            lo, hi = bisect_left(case.times, ts), bisect_right(case.times, ts)
            if p.order != "none" and lo < hi:  # equal timestamps
                back = len(case.times) - lo
                group = case.tail[lo:hi] + [sym]
                starts = [n for k, _, _, nodes in case.gens if k == back for n in sorted(nodes)]
                done = arrange(tree, p.order, group, starts)
                flag = 1 if done != group else None
                redo = [(s, ts) for s in done]
            else:
                back = len(case.times) - hi
            redo += zip(case.tail[hi:], case.times[hi:])
    if mult is None:
        if p.adapts and flag is not None:
            case.mult = max(p.multiplier, p.alpha * flag + (1 - p.alpha) * case.mult)
        mult = case.mult
    if case.gens is None:
        case.gens = [[0, 0, life(p, tree.avg_len, 0, mult) + 1, {0: None}]]
    if back:
        case.gens = [[k - back, c, d, nodes] for k, c, d, nodes in case.gens if k >= back]
        del case.tail[-back:], case.times[-back:]
        case.size -= back
    last = len(redo) - 1
    for i, (s, t) in enumerate(redo):
        _advance(tree, p, case, s, mult, i == last, keep)
        case.tail.append(s)
        case.times.append(t)
    surplus = len(case.tail) - case.gens[0][0]
    if surplus > 0:
        del case.tail[:surplus], case.times[:surplus]
    return flag, len(redo)


class State:
    """What a case carries from one event to the next, without times and with costs counted from its own; never changed."""

    __slots__ = ("size", "tail", "gens", "n_states", "more", "next")

    def __init__(self, size: int, tail: tuple, gens: list | None, n_states: int = 0, more: int = 0):
        self.size, self.tail, self.gens = size, tail, gens
        self.n_states, self.more = n_states, more  # as ``states`` and ``complete_cost`` without the cost
        self.next: dict = {}  # event or replay and lives -> (state, its cost)


#: States that ``Runs`` remembers.
KEPT_STATES = 30_000


class Runs:
    """Cases under several parameter sets, event by event, as ``observe`` takes them: the next state depends on the state, on the events to replay and on how long
    the new states live, so runs and cases that share these share the work.  Sets whose runs agree so far go on as one.  What is remembered is bounded."""

    def __init__(self, tree: Tree, sets: list[Params]):
        self.tree, self.sets = tree, sets
        self._kind = [(p.event_time_aware, p.min_decay, p.discounted) for p in sets]
        self._alike = [[i for i, kind in enumerate(self._kind) if kind == one] for one in dict.fromkeys(self._kind)]
        self._forget()

    def _forget(self) -> None:
        self._states: dict = {}
        self.start = State(0, (), None)

    def begin(self) -> list:
        """A case under all sets: state, cost, times of the retained events, and the sets that have these."""
        if self.tree.rest():
            self._forget()
        return [(self.start, 0, [], alike) for alike in self._alike]

    def observe(self, case: list, sym: int, ts: int, mults: list[float], out: list) -> list:
        """Take one event, with a multiplier for each set; returns the case after it.  ``out`` gets a result at the place of each set: (cost, states, open events,
        late flag or None, events replayed, complete cost)."""
        after = []
        for state, cost, times, alike in case:
            p, back, flag, at = self.sets[alike[0]], 0, None, len(times)
            if p.event_time_aware and at:
                flag = 0
                if ts <= times[-1]:
                    lo, at = bisect_left(times, ts), bisect_right(times, ts)
                    if lo < at and (len(alike) > 1 or p.order != "none"):
                        for order in dict.fromkeys(self.sets[i].order for i in alike):
                            some = [i for i in alike if self.sets[i].order == order]
                            self._tied(after, state, cost, times, some, order, sym, ts, lo, at, mults, out)
                        continue
                    back = len(times) - at
                    flag = 1 if back else 0
            self._go(after, state, cost, times, alike, (sym, *state.tail[at:]) if back else sym, back, ts, at, mults, flag, out)
        return after

    def _tied(self, after, state, cost, times, alike, order, sym, ts, lo, at, mults, out) -> None:
        """Equal timestamps: the sets of one order."""
        if order == "none":
            back = len(times) - at
            self._go(after, state, cost, times, alike, (sym, *state.tail[at:]) if back else sym, back, ts, at, mults, 1 if back else 0, out)
            return
        back = len(times) - lo
        group = [*state.tail[lo:at], sym]
        starts = [n for k, _, _, nodes in state.gens if k == back for n in sorted(nodes)]
        done = arrange(self.tree, order, group, starts)
        self._go(after, state, cost, times, alike, (*done, *state.tail[at:]), back, ts, at, mults, 1 if done != group else None, out)

    def _go(self, after, state, cost, times, alike, redo, back, ts, at, mults, flag, out) -> None:
        p, avg_len, size = self.sets[alike[0]], self.tree.avg_len, state.size - back
        if not p.discounted or size >= avg_len:
            ways = [(alike, (redo, p.min_decay))]
        else:
            found: dict = {}
            for i in alike:
                m = mults[i]
                lives = [int((avg_len - n) * m + 0.5) for n in range(size if state.gens is None else size + 1, min(size + back + 1, avg_len) + 1)]
                found.setdefault((redo, p.min_decay, *[x if x > p.min_decay else p.min_decay for x in lives]), []).append(i)
            ways = [(some, key) for key, some in found.items()]
        for some, key in ways:
            got = state.next.get(key)
            if got is None:
                got = state.next[key] = self._after(state, p, redo if back else (redo,), back, mults[some[0]])
            then, more = got
            if p.event_time_aware:
                now = times.copy()
                now.insert(at, ts)
                del now[: len(now) - len(then.tail)]
            else:
                now = times
            total = cost + more
            row = (total, then.n_states, then.gens[0][0], flag, back + 1, total + then.more)
            for i in some:
                out[i] = row
            for j, (other, its, when, sets) in enumerate(after):
                if other is then and its == total and when == now and self._kind[sets[0]] == self._kind[some[0]]:
                    after[j] = (then, total, now, sets + some)
                    break
            else:
                after.append((then, total, now, some))

    def _after(self, state: State, p: Params, redo: tuple, back: int, mult: float) -> tuple[State, int]:
        tree, case = self.tree, Case(mult)
        case.size, case.tail, case.gens = state.size - back, list(state.tail[: len(state.tail) - back]), state.gens
        if case.gens is None:
            case.gens = [[0, 0, life(p, tree.avg_len, 0, mult) + 1, {0: None}]]
        if back:
            case.gens = [[k - back, c, d, nodes] for k, c, d, nodes in case.gens if k >= back]
        last = len(redo) - 1
        for i, s in enumerate(redo):
            best, nodes = _fitting(tree, case.gens, s, False) or _reached(tree, case.gens, case.tail, s, False)
            _grow(tree, p, case, best, nodes, mult, i == last)
            case.tail.append(s)
        cost, tail = case.cost, tuple(case.tail[max(len(case.tail) - case.gens[0][0], 0) :])
        gens = [[k, c - cost, d, nodes] for k, c, d, nodes in case.gens]
        key = (case.size, tail, tuple([(k, c, d, tuple(nodes)) for k, c, d, nodes in gens]))
        kept = self._states.get(key)
        if kept is None:
            if len(self._states) >= KEPT_STATES:
                self._forget()
            kept = self._states[key] = State(case.size, tail, gens, sum(len(g[3]) for g in gens), min(tree.to_end[n] for n in gens[-1][3]))
        return kept, cost


def _advance(tree: Tree, p: Params, case: Case, sym: int, mult: float, last: bool, keep: bool) -> None:
    best, nodes = _fitting(tree, case.gens, sym, keep) or _reached(tree, case.gens, case.tail, sym, keep)
    _grow(tree, p, case, best, nodes, mult, last)


def _fitting(tree: Tree, gens: list, sym: int, keep: bool) -> tuple[int, dict] | None:
    """Cost and nodes of the new generation where the event fits below the newest one."""
    if not gens or gens[-1][0] != 0:
        return None
    nodes: dict = {}
    for n, al in gens[-1][3].items():
        to = tree.kids(n).get(sym)
        if to is not None:
            nodes.setdefault(to, (al, ((sym, sym),)) if keep else None)
    return (gens[-1][1], nodes) if nodes else None


def _reached(tree: Tree, gens: list, tail: list, sym: int, keep: bool) -> tuple[int, dict]:
    """Cost and nodes of the new generation otherwise."""
    nodes: dict = {}
    best = min(cost + k + 1 for k, cost, _, _ in gens)
    height, size = tree.height, len(tail)
    known = type(sym) is int
    for k, cost, _, at in reversed(gens):  # newest first
        events = None
        if cost + k + 1 == best:
            events = (*tail[size - k :], sym)
            for n, al in at.items():
                nodes.setdefault(n, (al, tuple((e, None) for e in events)) if keep else None)
        if cost > best or not known:
            continue
        for n, al in at.items():
            if height[n] < 2:  # model moves need a node to skip and one to reach
                continue
            events = events or (*tail[size - k :], sym)
            for to, sync, extra in tree.ahead(n, events, best - cost):
                if cost + extra < best:
                    best, nodes = cost + extra, {}
                if cost + extra == best and to not in nodes:
                    nodes[to] = (al, _moves(tree, n, to, events, sync)) if keep else None
    return best, nodes


def _grow(tree: Tree, p: Params, case: Case, best: int, nodes: dict, mult: float, last: bool) -> None:
    grown = [[k + 1, c, d - 1 if last else d, at] for k, c, d, at in case.gens if d >= 2]
    case.size += 1
    case.cost = best
    grown.append([0, best, life(p, tree.avg_len, case.size, mult), nodes])
    case.gens = grown


def _moves(tree: Tree, start: int, to: int, events: tuple, sync: int) -> tuple:
    cut = len(events) - sync
    way = tree.path(start, to)
    return (
        *((e, None) for e in events[:cut]),
        *((None, m) for m in way[: len(way) - sync]),
        *((e, e) for e in events[cut:]),
    )


def millis(times) -> list[int]:
    """Epoch milliseconds of an Arrow timestamp column; finer digits are cut, as ties are defined on milliseconds."""
    us = times.cast(pa.timestamp("us", times.type.tz)).cast(pa.int64()).to_numpy()
    return (us // 1000).tolist()


def states(case: Case) -> int:
    return sum(len(g[3]) for g in case.gens)


def complete_cost(tree: Tree, case: Case) -> int:
    """Cost if the case ended now: model moves to the nearest end are added."""
    return case.cost + min(tree.to_end[n] for n in case.gens[-1][3])


def alignment(tree: Tree, case: Case, node: int | None = None) -> list[tuple]:
    """Moves (log label, model label) of a reported state; None stands for a skip."""
    return [tuple(None if s is None else tree.label(s) for s in m) for moves in reversed(_parts(case, node)) for m in moves]


def _parts(case: Case, node: int | None = None) -> list[tuple]:
    """What each event added to the alignment of a state, the last first."""
    newest = case.gens[-1][3]
    al, parts = newest[min(newest) if node is None else node], []
    while al is not None:
        al, moves = al
        parts.append(moves)
    return parts


def _nearest(tree: Tree, case: Case) -> int:
    """Of the newest states the one nearest to an end."""
    return min(case.gens[-1][3], key=lambda n: (tree.to_end[n], n))


def complete_alignment(tree: Tree, case: Case) -> list[tuple]:
    """Moves if the case ended now: of the newest states the one nearest to an end, then model moves to that end."""
    node = _nearest(tree, case)
    return alignment(tree, case, node) + [(None, tree.labels[s]) for s in tree.ending(node)]


class Moves:
    """A column of alignments: the symbols of all moves in a row, a list of each side; -1 is a skip."""

    KIND = pa.struct([("log", pa.string()), ("model", pa.string()), ("cost", pa.int32())])

    def __init__(self, tree: Tree):
        self.tree, self.log, self.model, self.ends = tree, [], [], [0]
        self.strange: dict[str, int] = {}  # activities that the model does not know

    def add(self, parts: list[tuple], ending: tuple = ()) -> None:
        """One alignment from ``_parts``; model moves follow."""
        log, model = self.log, self.model
        for moves in reversed(parts):
            for a, b in moves:
                log.append(a if type(a) is int else -1 if a is None else self._number(a))
                model.append(-1 if b is None else b)
        log.extend((-1,) * len(ending))
        model.extend(ending)
        self.ends.append(len(model))

    def _number(self, activity: str) -> int:
        return self.strange.setdefault(activity, len(self.tree.labels) + len(self.strange))

    def array(self) -> pa.Array:
        log, model = np.array(self.log, np.int32), np.array(self.model, np.int32)
        names = pa.array([*self.tree.labels, *self.strange], pa.string()) if self.strange else self.tree.names
        sides = [names.take(pa.array(side, mask=side < 0)) for side in (log, model)]
        moves = pa.StructArray.from_arrays([*sides, pa.array(((log < 0) | (model < 0)).astype(np.int32))], fields=list(self.KIND))
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), moves)


def report(tree: Tree, case: Case, moves: Moves, ended: Moves) -> None:
    """Add the reported alignment and the complete one."""
    moves.add(_parts(case))
    node = _nearest(tree, case)
    ended.add(_parts(case, node), tree.ending(node))
