"""Spans of the texts of an Arrow batch (words, segments), hashed all at once, and values by span that a task keeps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_random = np.random.default_rng(20)
#: A random value per byte, and an odd base with its inverse modulo 2**64.
BYTE = _random.integers(1, 2**64 - 1, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n."""
    if len(_powers.get(base, ())) < max(1, n):
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text) of the words between ASCII white space."""
    inside = ~IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0xD6E8FEB86659FD93) ^ (h >> np.uint64(29))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: a polynomial over random values of the bytes, from running sums of the whole batch."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * _power(BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(INVERSE, n + 1)[starts])


class SpanValues:
    """Arrays of numbers by span, kept by hash; ``learn`` gets the bytes of spans not seen before and returns (all values, length per span)."""

    def __init__(self, kind: type, limit: int, learn: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]):
        self.kind, self.limit, self.learn = kind, limit, learn
        self._clear()

    def _clear(self) -> None:
        from tracefold.llm.prefix_bpe import IntTable

        self.table, self.flat, self.offsets = IntTable(), np.zeros(0, self.kind), np.zeros(1, np.int64)

    def take(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, flags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(values of all spans one after the other, where those of each span start, and the end).  Spans that differ in ``flags`` are different."""
        if len(self.offsets) > self.limit:
            self._clear()
        keys = hashes(data, starts, ends)
        if flags is not None:
            keys = mix(keys + flags.astype(np.uint64))
        keys = (keys >> np.uint64(1)).astype(np.int64)
        found = self.table.get(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            at = missing[first]
            whole = data.tobytes()
            values, sizes = self.learn([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], flags[at] if flags is not None else np.zeros(len(at)))
            self.table.put(new, np.arange(len(self.offsets) - 1, len(self.offsets) - 1 + len(new), dtype=np.int32))
            self.flat = np.concatenate([self.flat, values.astype(self.kind)])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
            found[missing] = self.table.get(keys[missing])
        begin = self.offsets[found]
        sizes = self.offsets[found + 1] - begin
        place = np.zeros(len(found) + 1, np.int64)
        np.cumsum(sizes, out=place[1:])
        return self.flat[np.repeat(begin - place[:-1], sizes) + np.arange(place[-1])], place


def join_values(parts: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(all values, lengths) of arrays by place."""
    ordered = [parts[i] for i in range(len(parts))]
    return (np.concatenate(ordered) if ordered else np.zeros(0)), np.fromiter(map(len, ordered), np.int64, len(ordered))
