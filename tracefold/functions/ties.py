"""Order of events that share a timestamp.

Strategies are registered by name; each gets (tree, group in delivery order, start nodes) and returns the group in a new
order, or None to keep the delivery order.  A strategy of your own must be registered in a module that tasks import too.
"""

from __future__ import annotations

from collections.abc import Callable

STRATEGIES: dict[str, Callable] = {}


def strategy(name: str):
    def add(fn):
        STRATEGIES[name] = fn
        return fn

    return add


def arrange(tree, order: str, group: list[int], starts: list[int]) -> list[int]:
    """The delivery order if the model allows it, else an order that the model allows, else what the strategy says."""
    if order == "none" or any(tree.walk(n, group) is not None for n in starts):
        return group
    for n in starts:
        fits = _fit(tree, n, list(group), 0)
        if fits is not None:
            return fits
    return STRATEGIES[order](tree, group, starts) or group


def _fit(tree, node: int, items: list[int], at: int) -> list[int] | None:
    """First permutation that the model allows below ``node``; only orders that are paths are looked at.  The stack is a list: groups may be long."""
    stack = [(node, items, at)]
    while stack:
        node, items, at = stack.pop()
        if at == len(items):
            return items
        kids, tried, below = tree.kids(node), set(), []
        for i in range(at, len(items)):
            s = items[i]
            if s in tried or s not in kids:
                continue
            tried.add(s)
            swapped = items.copy()
            swapped[at], swapped[i] = swapped[i], swapped[at]
            below.append((kids[s], swapped, at + 1))
        stack += reversed(below)
    return None


@strategy("ngrams")
def by_frequency(tree, group: list[int], starts: list[int]) -> list[int] | None:
    """The most frequent pattern of the model that is a permutation of the group."""
    if any(type(s) is str for s in group):
        return None
    best = tree.patterns.get(tuple(sorted(group)))
    return list(best) if best else None


@strategy("greedy")
def by_walk(tree, group: list[int], starts: list[int]) -> list[int] | None:
    """Longest match from any start, then the fewest skipped nodes to one more event of the group, and so on.

    Candidates that stand on the same node with the same events left are one candidate: the one nearest to the
    delivery order stays.
    """
    front = {(n, tuple(range(len(group)))): () for n in starts}
    while front:
        front = _longest(tree, group, front)
        if any(not left for _, left in front):
            break
        step = _hop(tree, group, front)
        if not step:
            break
        front = step
    if not front:
        return None
    (_, left), taken = min(front.items(), key=lambda kv: (kv[1] + kv[0][1], kv[0][0]))
    return [group[i] for i in taken + left]


def _take(group, kids, front_item, out) -> None:
    (_, left), taken = front_item
    tried = set()
    for i in left:
        s = group[i]
        if s in kids and s not in tried:
            tried.add(s)
            key, now = (kids[s], tuple(j for j in left if j != i)), (*taken, i)
            if key not in out or now < out[key]:
                out[key] = now


def _longest(tree, group, front: dict) -> dict:
    while True:
        longer: dict = {}
        for item in front.items():
            _take(group, tree.kids(item[0][0]), item, longer)
        if not longer:
            return front
        front = longer


def _hop(tree, group, front: dict) -> dict:
    """Skip the fewest nodes (at most as many as the group is large) after which an event of the group fits."""
    for _ in range(len(group) - 1):
        below: dict = {}
        for (n, left), taken in front.items():
            for c in tree.kids(n).values():
                key = (c, left)
                if key not in below or taken < below[key]:
                    below[key] = taken
        found: dict = {}
        for item in below.items():
            _take(group, tree.kids(item[0][0]), item, found)
        if found:
            return found
        front = below
    return {}
