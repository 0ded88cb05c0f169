"""Byte-pair encoding by dynamic programming over prefixes.

The encoding of a prefix is the encoding of a shorter prefix plus one last token, and of all tokens that end there only one does not merge differently with
the token before it.  So (number of tokens, last token) of each prefix follow from those of shorter prefixes.  ``many`` does this for a block of short
texts at a time, one position of all of them per step; ``one`` does it for a single text of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Texts up to this length go through ``many``, in blocks of so many cells.
SHORT = 48
CELLS = 2_000_000


class IntTable:
    """Whole numbers by whole numbers of 0 or more, looked up and added many at a time (open addressing)."""

    def __init__(self, size: int = 1 << 16):
        self._clear(size)

    def _clear(self, size: int) -> None:
        self.keys, self.values, self.used = np.full(size, -1, np.int64), np.full(size, -1, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - int(len(self.keys)).bit_length() + 1)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of ``keys``, -1 where there is none."""
        slots = self._slots(keys)
        at = self.keys[slots]
        out = np.where(at == keys, self.values[slots], -1)
        open_ = np.flatnonzero((at != keys) & (at != -1))
        slots = slots[open_]
        while len(open_):
            slots = (slots + 1) & (len(self.keys) - 1)
            at, want = self.keys[slots], keys[open_]
            hit = at == want
            out[open_[hit]] = self.values[slots[hit]]
            more = ~hit & (at != -1)
            open_, slots = open_[more], slots[more]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that differ and aren't there yet."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.keys >= 0
            kept, kept_values = self.keys[old], self.values[old]
            self._clear(1 << int(2 * (len(kept) + len(keys))).bit_length())
            self.put(kept, kept_values)
        self.used += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] == -1)
            self.keys[slots[free]] = keys[free]
            won = self.keys[slots] == keys
            self.values[slots[won]] = values[won]
            keys, values, slots = keys[~won], values[~won], (slots[~won] + 1) & (len(self.keys) - 1)


class PrefixBPE:
    """``tokens``: ids by text.  ``rank(a, b)``: priority of joining two tokens, lowest first and leftmost among equals, None where they don't join.
    ``end``: a character that can only be the last of a text and belongs to the symbol before it."""

    def __init__(self, tokens: dict[str, int], rank: Callable[[str, str], float | None], end: str = "", pairs: int = 4_000_000):
        self.tokens, self.rank, self.end, self.limit = tokens, rank, end, pairs
        self.text = {i: t for t, i in tokens.items()}
        self.longest, self.base = max(map(len, tokens)), max(tokens.values()) + 2
        codes = {c: i for i, c in enumerate(sorted({c for t in tokens for c in t}))}
        self.codes = np.full(0x110000, -1, np.int32)
        self.codes[[ord(c) for c in codes]] = list(codes.values())
        self.width = len(codes)
        nodes, ids = {}, [-1]  # (node, code) to node; token of a node
        for t, i in tokens.items():
            at = 0
            for c in t:
                key = at * self.width + codes[c]
                if key not in nodes:
                    nodes[key] = len(ids)
                    ids.append(-1)
                at = nodes[key]
            ids[at] = i
        self.trie, self.ids = IntTable(), np.array(ids, np.int32)
        self.trie.put(np.fromiter(nodes, np.int64), np.fromiter(nodes.values(), np.int32))
        self.pairs = IntTable()

    def symbols(self, token: str) -> list[str]:
        out = list(token)
        if self.end and len(out) > 1 and out[-1] == self.end:
            out[-2:] = ["".join(out[-2:])]
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        """The encoding by its definition: join the best pair until none is left."""
        symbols = list(symbols)
        while True:
            ranked = [(r, i) for i in range(len(symbols) - 1) if (r := self.rank(symbols[i], symbols[i + 1])) is not None]
            if not ranked:
                return symbols
            i = min(ranked)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def fits(self, before: str, token: str) -> bool:
        """Whether the two stay as they are next to each other."""
        return self.merge(self.symbols(before) + self.symbols(token)) == ([before] if before else []) + [token]

    def _fit(self, keys: np.ndarray) -> np.ndarray:
        """``fits`` for pairs of ids, as (id before + 1) * base + id; known pairs are kept."""
        found = self.pairs.get(keys)
        if (found < 0).any():
            new = np.unique(keys[found < 0])
            if self.pairs.used + len(new) > self.limit:
                self.pairs = IntTable()
                new = np.unique(keys)
            text = self.text
            values = np.array([self.fits(text[b - 1] if b else "", text[i]) for b, i in zip((new // self.base).tolist(), (new % self.base).tolist(), strict=True)], np.int32)
            self.pairs.put(new, values)
            found = self.pairs.get(keys)
        return found == 1

    def one(self, text: str) -> tuple[list[int], list[str]]:
        """(number of tokens, last token) of each prefix from the empty one; a character that is no token stands alone."""
        counts, last, known = [0], [""], {}
        for end in range(1, len(text) + 1):
            for size in range(min(self.longest, end), 0, -1):
                token = text[end - size : end]
                if size == 1 and token != self.end or token in self.tokens:
                    pair = last[end - size], token
                    if pair not in known:
                        known[pair] = self.fits(*pair)
                    if known[pair]:
                        counts.append(counts[end - size] + 1)
                        last.append(token)
                        break
        return counts, last

    def many(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (places in ``texts``, lengths, counts, last ids), the last two by text and length of the prefix.  All characters must be known."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            rows = max(1, CELLS // 4 // (int(sizes[order[at]]) + 8))
            places = order[at : at + rows]
            at += len(places)
            yield places, sizes[places], *self._block([texts[i] for i in places.tolist()], sizes[places])

    def spans(self, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end, id) of all tokens found in the texts, by end; and codes of the characters by text and place, -1 for unknown ones and behind the end."""
        n, wide = len(texts), int(sizes.max(initial=0))
        codes = np.full((n, wide + 1), -1, np.int32)
        codes[np.arange(wide + 1) < sizes[:, None]] = self.codes[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        # walk the trie from all places at once
        row, start = np.nonzero(codes >= 0)
        node, end, found = np.zeros(len(row), np.int64), start.copy(), []
        while len(row):
            code = codes[row, end]
            node = np.where(code >= 0, self.trie.get(node * self.width + np.maximum(code, 0)), -1)
            alive = node >= 0
            row, start, node, end = row[alive], start[alive], node[alive].astype(np.int64), end[alive] + 1
            token = self.ids[node]
            is_token = token >= 0
            found.append((row[is_token], start[is_token], end[is_token], token[is_token]))
        row, start, end, token = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
        order = np.argsort(end, kind="stable")
        return row[order], start[order], end[order], token[order], codes

    def _block(self, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, wide = len(texts), int(sizes.max(initial=0))
        row, start, end, token, _ = self.spans(texts, sizes)
        cuts = np.searchsorted(end, np.arange(1, wide + 2))
        counts, last = np.zeros((n, wide + 1), np.int16), np.full((n, wide + 1), -1, np.int32)
        for at in range(1, wide + 1):
            r, s, t = (v[cuts[at - 1] : cuts[at]] for v in (row, start, token))
            before = last[r, s].astype(np.int64)
            fit = self._fit((before + 1) * self.base + t) & ((s == 0) | (before >= 0))
            r, s = r[fit], s[fit]
            last[r, at] = t[fit]
            counts[r, at] = counts[r, s] + 1
        return counts, last
