"""Slow, direct checker used as the yardstick: every partial alignment is kept as its own list of moves."""

from __future__ import annotations

import itertools
import math
from collections import Counter


class Naive:
    def __init__(self, traces, params, max_pattern=10):
        self.p = params
        self.nodes, self.ends, visits = {()}, set(), []
        self.freq = Counter()
        for t in traces:
            t = tuple(t)
            self.ends.add(t)
            for i in range(1, len(t) + 1):
                self.nodes.add(t[:i])
                if t[:i] in self.ends:
                    visits.append(i)
            for n in range(2, min(len(t), max_pattern) + 1):
                self.freq.update(t[i : i + n] for i in range(len(t) - n + 1))
        self.avg = sum(visits) // len(visits)
        self.alphabet = sorted({t for node in self.nodes for t in node})
        self.mult = params.multiplier
        self.cases, self.times = {}, {}
        self.pinned = None  # multiplier per event from outside

    def kids(self, node):
        return [node + (a,) for a in self.alphabet if node + (a,) in self.nodes]

    def life(self, moves):
        size = sum(1 for log, _ in moves if log is not None)
        return max(math.floor((self.avg - size) * self.mult + 0.5), self.p.min_decay)

    def flag(self, late):
        if self.p.adapts:
            self.mult = max(self.p.multiplier, self.p.alpha * late + (1 - self.p.alpha) * self.mult)

    def arrange(self, group, starts):
        for s in starts:
            if s + tuple(group) in self.nodes:
                return group
        perms = list(itertools.permutations(group))
        for s in starts:
            fit = [q for q in perms if s + q in self.nodes]
            if fit:
                return list(fit[0]) if len(set(fit)) == 1 else ("any", {q for q in fit})
        best = [(-self.freq[q], q) for q in set(perms) if self.freq[q]]
        return list(min(best)[1]) if best else group

    def event(self, case, a, ts):
        """Returns (cost, number of distinct (k, node) states, flag)."""
        p, flag, redo = self.p, None, [(a, ts)]
        if case not in self.cases:
            self.cases[case] = [dict(moves=(), post=(), node=(), cost=0, life=self.life(()) + 1)]
            self.times[case] = []
        else:
            line = self.times[case]
            if p.event_time_aware and line:
                flag = 0
                top = line[-1][1]
                if ts < top or (p.order != "none" and ts <= top):
                    same = [x for x in line if x[1] == ts]
                    later = [x for x in line if x[1] > ts]
                    flag, back = 1, len(later)
                    if p.order != "none" and same:
                        back += len(same)
                        group = [x[0] for x in same] + [a]
                        starts = sorted({s["node"] for s in self.cases[case] if len(s["post"]) == back})
                        done = self.arrange(group, starts)
                        if done and done[0] == "any" and isinstance(done[1], set):
                            raise LookupError  # several orders fit: not decided here
                        flag = 1 if list(done) != group else None
                        redo = [(x, ts) for x in done]
                    redo += later
                    self.cases[case] = [dict(s, post=s["post"][: len(s["post"]) - back]) for s in self.cases[case] if len(s["post"]) >= back]
                    del line[len(line) - back :]
                if flag is not None:
                    self.flag(flag)
        if self.pinned is not None:
            self.mult = self.pinned
        for i, (x, t) in enumerate(redo):
            self.cases[case] = self.one(self.cases[case], x, i == len(redo) - 1)
            self.times[case].append((x, t))
        keep = max(len(s["post"]) for s in self.cases[case])
        self.times[case] = self.times[case][len(self.times[case]) - keep :] if keep else []
        now = [s for s in self.cases[case] if not s["post"]]
        assert len({s["cost"] for s in now}) == 1, "states of one generation differ in cost"
        for s in self.cases[case]:
            assert s["cost"] == sum(1 for m in s["moves"] if None in m)
        return now[0]["cost"], len({(len(s["post"]), s["node"]) for s in self.cases[case]}), flag

    def one(self, states, x, last):
        fresh = {}

        def add(moves, node, cost):
            fresh[moves] = dict(moves=moves, post=(), node=node, cost=cost, life=self.life(moves))

        for s in states:
            if not s["post"] and s["node"] + (x,) in self.nodes:
                add(s["moves"] + ((x, x),), s["node"] + (x,), s["cost"])
        if not fresh:
            options = []
            for s in states:
                seq = s["post"] + (x,)
                options.append((s["cost"] + len(seq), s["moves"] + tuple((e, None) for e in seq), s["node"]))
                options += self.model_moves(s, seq)
            best = min(o[0] for o in options)
            for cost, moves, node in options:
                if cost == best:
                    add(moves, node, cost)
        kept = [dict(s, post=s["post"] + (x,), life=s["life"] - last) for s in states if s["life"] >= 2]
        return kept + list(fresh.values())

    def model_moves(self, s, seq):
        for drop in range(len(seq)):
            rest = seq[drop:]
            for depth in range(1, len(rest) + 1):
                hits = [n + rest for n in self.nodes if len(n) == len(s["node"]) + depth and n[: len(s["node"])] == s["node"] and n + rest in self.nodes]
                if hits:
                    return [self.back(s, seq, h) for h in hits]
        return []

    def back(self, s, seq, hit):
        way = hit[len(s["node"]) :]
        sync = 0
        while sync < min(len(way), len(seq)) and way[-1 - sync] == seq[-1 - sync]:
            sync += 1
        logs, models = seq[: len(seq) - sync], way[: len(way) - sync]
        moves = tuple((e, None) for e in logs) + tuple((None, m) for m in models) + tuple((e, e) for e in seq[len(seq) - sync :])
        return s["cost"] + len(logs) + len(models), s["moves"] + moves, hit


def prefix_distance(nodes, events):
    """Exact prefix distance: fewest log and model moves to any node."""
    best = len(events)
    for n in nodes:
        lcs = [0] * (len(n) + 1)
        for e in events:
            prev = 0
            for j, m in enumerate(n):
                prev, lcs[j + 1] = lcs[j + 1], max(lcs[j + 1], lcs[j], prev + 1 if e == m else 0)
        best = min(best, len(events) + len(n) - 2 * lcs[-1])
    return best
