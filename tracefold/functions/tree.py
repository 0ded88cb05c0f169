"""The model inside a task: children of a node, and the two searches the fold needs.

Activities of the model are numbers; an activity that the model does not know stays a string and matches nothing.

``Tree`` holds the whole model (broadcast, size-checked).  ``ArrayTree`` reads the written model table into arrays of about 20 bytes a node when the model
is too large to be broadcast; both number nodes alike, from 0 = root.  ``TableTree`` reads children on demand when that is too large, too.
"""

from __future__ import annotations

import pickle
import zlib
from collections import OrderedDict
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROOT_SYMBOL = -1
SEPARATOR = "\x1f"  # between labels in the text of a bag
#: Searches and hits that are remembered, and nodes whose children are kept as a dict.
MEMO_LIMIT, KEPT_KIDS = 30_000, 20_000
#: Symbols of the ways to the nearest end that are kept.
KEPT_MOVES = 1_000_000


class Tree:
    _weight, _ending_moves = 0, 0  # of what is remembered

    def __init__(self, data: dict):
        self.labels = data["labels"]  # in order of the symbol number
        self.number = {a: i for i, a in enumerate(self.labels)}
        self.avg_len = data["avg_len"]
        self.patterns = pattern_lookup(data["patterns"], self)  # sorted symbols -> most frequent order
        # views: the value stays with the worker process anyway
        view = lambda name: memoryview(data[name]).cast("q")
        self.parent, self.symbol, self.level = view("parent"), view("symbol"), view("level")
        self.to_end, self.height = view("min_to_end"), view("max_to_end")
        self._offset, self._child = view("offset"), view("child")
        self._z1, self._z2 = view("z1"), view("z2")
        self._named: dict | None = None
        self._kids: dict[int, dict[int, int]] = {}
        self._memo: dict = {}
        self._endings: dict[int, tuple[int, ...]] = {}

    def kids(self, node: int) -> dict[int, int]:
        got = self._kids.get(node)
        if got is None:
            got = self._below(node)
            if len(self._kids) >= KEPT_KIDS:
                self._kids.clear()
            self._kids[node] = got
        return got

    def _below(self, node: int) -> dict[int, int]:
        return {self.symbol[c]: c for c in self._child[self._offset[node] : self._offset[node + 1]]}

    def rest(self) -> bool:
        """Called between cases: what was only cached is dropped where it is filled, as cases may be long.  True if nodes are numbered anew."""
        return False

    def ending(self, node: int) -> tuple[int, ...]:
        """Symbols on the way down to the nearest end, the smallest of equally near ones; ways that were asked for are kept up to ``KEPT_MOVES`` symbols."""
        got = self._endings.get(node)
        if got is None:
            to_end, at, way = self.to_end, node, []
            for left in range(to_end[node] - 1, -1, -1):
                symbol, at = next((s, c) for s, c in self._below(at).items() if to_end[c] == left)  # children are in the order of their symbols
                way.append(symbol)
            got = tuple(way)
            if self._ending_moves > KEPT_MOVES:
                self._endings.clear()
                self._ending_moves = 0
            self._ending_moves += len(got) + 20
            self._endings[node] = got
        return got

    @cached_property
    def names(self) -> pa.Array:
        return pa.array(self.labels, pa.string())

    def walk(self, node: int, seq) -> int | None:
        for s in seq:
            node = self.kids(node).get(s)
            if node is None:
                return None
        return node

    def ahead(self, node: int, events: tuple, budget: int) -> list[tuple[int, int, int]]:
        """Where model moves can lead: [(node, synchronous events at the end, extra cost)] with extra cost <= budget.

        The open events must be reached over at least one skipped node and at most as many as there are open events,
        the fewest that work.  If nothing works the oldest open event is given up and the rest is tried again.
        """
        if budget < 0 or type(events[-1]) is str:
            return []
        key = (node, events, budget)
        got = self._memo.get(key)
        if got is None:
            got = [s for s in self._ahead(node, events, budget) if s[2] <= budget]
            if self._weight >= MEMO_LIMIT:
                self._memo.clear()
                self._weight = 0
            self._weight += 1 + len(got)
            self._memo[key] = got
        return got

    def _ahead(self, node: int, events: tuple, budget: int) -> list[tuple[int, int, int]]:
        """Of all (events given up, nodes skipped) the first pair that hits counts.

        Its cost is the sum of the two, unless the events also fit directly below the node after giving up fewer of them.
        So without such a direct fit only pairs within the budget are tried, and the costlier pairs before a hit are
        looked at only once there is one.
        """
        n, room = len(events), self.height[node]
        if room < 2:
            return []
        known = next((i for i, s in enumerate(reversed(events)) if type(s) is str), n)
        first = max(n - known, n + 1 - room)  # what is left after giving up must fit below a skipped node
        kids, kept = self.kids, self._kids
        layers = [[node]]

        def hits(given_up: int, skipped: int) -> list[int]:
            while len(layers) <= skipped:
                layers.append([c for p in layers[-1] for c in (kept.get(p) or kids(p)).values()])
            found = layers[skipped]
            for s in events[given_up:]:
                found = [c for at in found if (c := (kept.get(at) or kids(at)).get(s)) is not None]
                if not found:
                    break
            return found

        def deepest(given_up: int) -> int:
            return min(n - given_up, room - n + given_up)

        direct = any(self.walk(node, events[h:]) is not None for h in range(max(first - 1, 0), min(budget, n - 2) + 1))
        for g in range(first, n if direct else min(n, budget)):
            for d in range(1, (deepest(g) if direct else min(deepest(g), budget - g)) + 1):
                found = hits(g, d)
                if found:
                    before = () if direct else range(first, g)
                    if any(hits(g2, d2) for g2 in before for d2 in range(budget - g2 + 1, deepest(g2) + 1)):
                        return []
                    return [self._score(node, h, events) for h in found]
        return []

    def _score(self, node: int, hit: int, open_events: tuple) -> tuple[int, int, int]:
        sync, at = 0, hit
        for s in reversed(open_events):
            if at == node or self.symbol[at] != s:
                break
            sync, at = sync + 1, self.parent[at]
        skipped = self.level[hit] - self.level[node] - sync
        return hit, sync, skipped + len(open_events) - sync

    def label(self, symbol):
        return self.labels[symbol] if type(symbol) is int else symbol

    def path(self, node: int, down_to: int) -> list[int]:
        """Symbols on the way from ``node`` (excluded) down to a node below it."""
        out = []
        while down_to != node:
            out.append(self.symbol[down_to])
            down_to = self.parent[down_to]
        return out[::-1]

    def find_node(self, level: int, z1: int, z2: int) -> int:
        """Number of a node by its identity."""
        if self._named is None:
            self._named = {k: i for i, k in enumerate(zip(self.level, self._z1, self._z2))}
        return self._named[(level, z1, z2)]

    def identity(self, node: int) -> tuple[int, int, int]:
        """(level, z1, z2) of a node, as in the node table."""
        return self.level[node], self._z1[node], self._z2[node]

    def key(self, node: int):
        """Name of a node that any task understands, also with a later model that still has the prefix."""
        return [self.level[node], self._z1[node], self._z2[node]]

    def find(self, key) -> int:
        return self.find_node(*key)


ARRAY_COLUMNS = ["n", "p", "first", "next", "level", "symbol", "min_to_end", "max_to_end"]


class ArrayTree(Tree):
    """The whole model in arrays, read by each worker process from its written table: a row per node with its number ``n`` and its parent's, whether it is the
    ``first`` of its siblings by label, and the ``next`` of them (0: none)."""

    def __init__(self, data: dict):
        self.labels, self.avg_len = data["labels"], data["avg_len"]
        self.number = {a: i for i, a in enumerate(self.labels)}
        self.patterns = pattern_lookup(data["patterns"], self)
        self._path, self._size = data["path"], data["size"]
        small = lambda most: np.uint8 if most < 2**8 else np.uint16 if most < 2**16 else np.int32
        blank = lambda kind: np.zeros(self._size, kind)
        parent, first, following = blank(np.int32), blank(np.int32), blank(np.int32)
        # no way is longer than the root's longest
        level, to_end, height = (blank(small(data["root"][1])) for _ in range(3))
        symbol, labels = blank(small(len(self.labels))), pa.array(self.labels, pa.string())
        for batch in read_batches(self._path, ARRAY_COLUMNS):
            n, p, is_first, after, lv, _, least, most = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) if c != "symbol" else None for c in ARRAY_COLUMNS)
            parent[n], following[n], level[n], to_end[n], height[n] = p, after, lv, least, most
            symbol[n] = pc.index_in(batch.column("symbol"), value_set=labels).to_numpy(zero_copy_only=False)
            first[p[is_first]] = n[is_first]
        parent[0], to_end[0], height[0] = -1, *data["root"]
        self.parent, self.symbol, self.level, self.to_end, self.height = map(memoryview, (parent, symbol, level, to_end, height))
        self._first, self._next = memoryview(first), memoryview(following)
        self._names = None
        self._kids, self._memo, self._endings = {}, {}, {}

    def _below(self, node: int) -> dict[int, int]:
        symbol, following, at, got = self.symbol, self._next, self._first[node], {}
        while at:
            got[symbol[at]] = at
            at = following[at]
        return got

    def identity(self, node: int) -> tuple[int, int, int]:
        if self._names is None:  # only where nodes are reported
            names = np.zeros((2, self._size), np.int64)
            for batch in read_batches(self._path, ["n", "z1", "z2"]):
                names[:, np.asarray(batch.column("n"))] = np.asarray(batch.column("z1")), np.asarray(batch.column("z2"))
            self._names = memoryview(names[0]), memoryview(names[1])
        return self.level[node], self._names[0][node], self._names[1][node]

    def key(self, node: int):
        """The labels on the way to the node: can be walked again in any task."""
        return [self.labels[s] for s in self.path(0, node)]

    def find(self, key) -> int:
        return self.walk(0, [self.number[a] for a in key])


BUCKET_COLUMNS = ["p_level", "p_z1", "p_z2", "symbol", "level", "z1", "z2", "min_to_end", "max_to_end"]


class TableTree(Tree):
    """Children come from the model table in the shared folder: one file per bucket of parents, a few kept in memory.

    Node numbers are local to the task.  ``rest`` forgets them between cases once there are too many.
    """

    KEEP_BUCKETS = 16
    KEEP_NODES = 1_000_000

    def __init__(self, data: dict):
        self.labels, self.avg_len = data["labels"], data["avg_len"]
        self.number = {a: i for i, a in enumerate(self.labels)}
        self.patterns = pattern_lookup(data["patterns"], self)
        self._path, self._buckets, self._root = data["path"], data["buckets"], data["root"]
        self._loaded: OrderedDict = OrderedDict()
        self._reset()

    def _reset(self) -> None:
        self.parent, self.symbol, self.level = [-1], [ROOT_SYMBOL], [0]
        self.to_end, self.height = [self._root[0]], [self._root[1]]
        self._keys = [(0, 0, 0)]
        self._at = {(0, 0, 0): 0}
        self._kids, self._memo, self._endings = {}, {}, {}

    def rest(self) -> bool:
        full = len(self._keys) > self.KEEP_NODES or len(self._memo) > MEMO_LIMIT
        if full:
            self._reset()
        return full

    def _bucket(self, b: int):
        got = self._loaded.pop(b, None)
        if got is None:
            rows = read_folder(f"{self._path}/bucket={b}")
            got = {}
            if rows is not None:
                for pl, p1, p2, sym, lv, z1, z2, *ends in zip(*(rows[c] for c in BUCKET_COLUMNS)):
                    got.setdefault((pl, p1, p2), []).append((sym, (lv, z1, z2), ends))
                for kids in got.values():
                    kids.sort()
        self._loaded[b] = got
        if len(self._loaded) > self.KEEP_BUCKETS:
            self._loaded.popitem(last=False)
        return got

    def _add(self, parent: int, sym: int, key: tuple, ends: list[int]) -> int:
        at = self._at.get(key)
        if at is None:
            at = self._at[key] = len(self._keys)
            self._keys.append(key)
            self.parent.append(parent)
            self.symbol.append(sym)
            self.level.append(key[0])
            self.to_end.append(ends[0])
            self.height.append(ends[1])
        return at

    def kids(self, node: int) -> dict[int, int]:
        got = self._kids.get(node)
        if got is None:
            key = self._keys[node]
            rows = self._bucket(key[1] % self._buckets).get(key, [])
            got = {self.number[a]: self._add(node, self.number[a], k, e) for a, k, e in rows}
            self._kids[node] = got
        return got

    _below = kids  # node numbers are given here

    def identity(self, node: int) -> tuple[int, int, int]:
        return self._keys[node]

    def key(self, node: int):
        """The labels on the way to the node: can be walked again in any task."""
        return [self.labels[s] for s in self.path(0, node)]

    def find(self, key) -> int:
        return self.walk(0, [self.number[a] for a in key])


class TablePatterns:
    """Most frequent orders from their table in the shared folder, one file per bucket of bags."""

    def __init__(self, data: dict, tree: Tree):
        self._path, self._buckets, self._tree = data["path"], data["buckets"], tree
        self._loaded: OrderedDict = OrderedDict()

    def get(self, symbols: tuple) -> tuple | None:
        text = SEPARATOR.join(self._tree.labels[s] for s in symbols)  # symbols are numbered in the order of labels
        b = zlib.crc32(text.encode()) % self._buckets
        rows = self._loaded.pop(b, None)
        if rows is None:
            cols = read_folder(f"{self._path}/bucket={b}") or {"bag": [], "pattern": []}
            rows = dict(zip(cols["bag"], cols["pattern"]))
        self._loaded[b] = rows
        if len(self._loaded) > TableTree.KEEP_BUCKETS:
            self._loaded.popitem(last=False)
        found = rows.get(text)
        return tuple(self._tree.number[a] for a in found) if found else None


def pattern_lookup(data: dict, tree: Tree):
    return TablePatterns(data, tree) if "path" in data else data


def build(data: dict) -> Tree:
    return ArrayTree(data) if "size" in data else TableTree(data) if "path" in data else Tree(data)


def read_batches(path: str, columns: list[str]):
    """Batches of a parquet folder in the shared storage, a few in memory at a time."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    found = ds.dataset(path, filesystem=system, format="parquet")
    yield from found.to_batches(columns=columns, batch_size=65_536, batch_readahead=1, fragment_readahead=1, use_threads=False)


def read_folder(path: str) -> dict | None:
    """Columns of a small parquet folder in the shared storage, read inside a task; None if it is not there."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    return ds.dataset(path, filesystem=system, format="parquet").to_table().to_pydict()


_TREES: dict = {}
#: Trees by broadcast that a worker process keeps at most: a large one leaves no room for others.
KEPT = 1


def published_tree(path: str) -> Tree:
    """The tree whose data ``Model.publish`` wrote; kept by the worker process."""
    if path not in _TREES:
        _TREES.clear()
        _TREES[path] = build(pickle.loads(read_folder(path)["data"][0]))
    return _TREES[path]


def local_tree(shipped) -> Tree:
    """The tree of this worker process.  The value is held beside its tree, so no other value can take its identity meanwhile."""
    value = shipped.value
    held, tree = _TREES.get(id(value), (None, None))
    if held is not value:
        while len(_TREES) >= KEPT:
            _TREES.pop(next(iter(_TREES)))
        tree = build(value)
        _TREES[id(value)] = value, tree
    return tree


def pack(pdf, labels: list[str], avg_len: int, patterns: dict, root: tuple[int, int]) -> dict:
    """Arrays of the whole tree from the collected node table (level, z1, z2, p_z1, p_z2, symbol, first_trace,
    min_to_end, max_to_end); ``root``: its shortest and longest way to an end."""
    pdf = pdf.sort_values(["level", "first_trace"], kind="stable").reset_index(drop=True)
    number = {a: i for i, a in enumerate(labels)}
    at = {k: i + 1 for i, k in enumerate(zip(pdf["level"], pdf["z1"], pdf["z2"]))}
    at[(0, 0, 0)] = 0
    n = len(pdf) + 1
    parent = np.fromiter((at[k] for k in zip(pdf["level"] - 1, pdf["p_z1"], pdf["p_z2"])), np.int64, n - 1)
    symbol = np.fromiter((number[a] for a in pdf["symbol"]), np.int64, n - 1)
    by_parent = np.lexsort((symbol, parent))
    offset = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(parent, minlength=n), out=offset[1:])
    ints = lambda head, col: np.concatenate([[head], np.asarray(col, np.int64)]).tobytes()
    return {
        "labels": labels,
        "avg_len": avg_len,
        "patterns": patterns,
        "parent": ints(-1, parent),
        "symbol": ints(ROOT_SYMBOL, symbol),
        "level": ints(0, pdf["level"]),
        "min_to_end": ints(root[0], pdf["min_to_end"]),
        "max_to_end": ints(root[1], pdf["max_to_end"]),
        "offset": offset.tobytes(),
        "z1": ints(0, pdf["z1"]),
        "z2": ints(0, pdf["z2"]),
        "child": (by_parent + 1).astype(np.int64).tobytes(),
    }
