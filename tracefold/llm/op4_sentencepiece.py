"""SentencePiece encoding by sampling, and decoding.

Segmentations of a text are paths through the lattice of pieces.  Weights of pieces sum up forward over the lattice; walking backward, each piece is drawn with its
share of the sum that ends there, which gives a path with probability in proportion to its weight (forward filtering, backward sampling).  A piece weighs
``(rank + 2) ** -alpha``: the model's pieces come in the order in which they were merged.  Draws are a hash of the row key, the segment's number in its text and
the step, so they don't depend on partitions or on other rows.

No piece holds a space after another character, so segments between spaces are lattices of their own, kept by each task (at most ``CACHE``).  Characters that no
piece has, and the mark that stands for a space if a text itself holds it, become byte pieces; with that decoding is lossless.

Null texts count as empty: no pieces.  Rows with a null key are drawn with a fixed key; repeated rows get equal segmentations.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import map_batches, table
from tracefold.llm.op7_token_counts import MARK, model_path
from tracefold.llm.prefix_bpe import PrefixBPE
from tracefold.llm.spans import SpanValues, mix, text_bytes

ALPHA = 2.0
CACHE = 300_000
EDGES = 6_000_000
#: Cells (segments by places) whose edges are found at once.
CELLS = 100_000


class Pieces:
    """The pieces of a model and how to go back from ids to text."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path(path))
        size = range(model.vocab_size())
        byte = {i: int(model.id_to_piece(i)[3:5], 16) for i in size if model.is_byte(i)}
        self.plain = {model.id_to_piece(i): i for i in size if i not in byte and not (model.is_control(i) or model.is_unknown(i))}
        if any(MARK in p.lstrip(MARK) for p in self.plain):
            raise ValueError("a piece crosses a space: texts can't be cut there")
        self.byte_id = np.zeros(256, np.int64)
        self.byte_id[list(byte.values())] = list(byte)
        text = {i: p.replace(MARK, " ").encode() for p, i in self.plain.items()} | {i: bytes([b]) for i, b in byte.items()}
        self.size = np.array([len(text.get(i, b"")) for i in size], np.int64)
        self.begin, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(text.get(i, b"") for i in size), np.uint8)

    def decode(self, ids: np.ndarray, place: np.ndarray) -> pa.Array:
        """Texts of ids that lie one text after the other from ``place`` on; the space that the model puts before a text goes."""
        sizes = self.size[ids]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        out = self.bytes[np.repeat(self.begin[ids] - sums[:-1], sizes) + np.arange(sums[-1])]
        starts = sums[place]
        keep = np.ones(len(out), bool)
        some = starts[:-1] < starts[1:]
        keep[starts[:-1][some]] = False
        offsets = starts - np.concatenate([[0], np.cumsum(some)])
        return pa.StringArray.from_buffers(len(place) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out[keep].tobytes()))


class Sampler:
    def __init__(self, pieces: Pieces, alpha: float = ALPHA, seed: int = 0):
        self.pieces, self.seed = pieces, seed
        self.lattice = PrefixBPE(pieces.plain, lambda a, b: None)
        ids = np.array(sorted(pieces.plain.values()))
        self.weight = np.full(self.lattice.base, -np.inf)
        self.weight[ids] = -alpha * np.log(np.arange(len(ids)) + 2.0)
        self.unknown = -alpha * np.log(len(ids) + 2.0)
        self._clear()

    def _clear(self) -> None:
        self.known = SpanValues(np.int64, CACHE, self._learn)
        #: Edges by (segment, end): end's number plus the running share of its edges, where an edge starts, its id (or -1 - code point).
        self.share, self.start, self.token, self.places = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def _learn(self, spans: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [(MARK if f else "") + s.decode().replace(MARK, "\ue000").replace(" ", MARK) for s, f in zip(spans, first.tolist(), strict=True)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order, base = np.argsort(sizes, kind="stable"), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(order):
            take = order[at : at + max(1, CELLS // (int(sizes[order[at]]) + 8))]
            take = take[sizes[take] <= max(int(sizes[take[0]]) * 2, 16)]
            at += len(take)
            self._edges([texts[i] for i in take.tolist()], sizes[take], base, take)
        return np.stack([base, sizes], axis=1).ravel(), np.full(len(texts), 2)

    def _edges(self, texts: list[str], sizes: np.ndarray, base: np.ndarray, where: np.ndarray) -> None:
        row, start, end, token, codes = self.lattice.spans(texts, sizes)
        n, wide = len(texts), int(sizes.max())
        weight = self.weight[token]
        lone_row, lone = np.nonzero((codes < 0) & (np.arange(wide + 1) < sizes[:, None]))
        if len(lone):
            points = np.array([ord(texts[r][i]) for r, i in zip(lone_row.tolist(), lone.tolist(), strict=True)], np.int64)
            points[points == 0xE000] = ord(MARK)
            row, start, end = np.concatenate([row, lone_row]), np.concatenate([start, lone]), np.concatenate([end, lone + 1])
            token, weight = np.concatenate([token, -1 - points]), np.concatenate([weight, np.full(len(lone), self.unknown)])
            order = np.argsort(end, kind="stable")
            row, start, end, token, weight = (v[order] for v in (row, start, end, token, weight))
        cuts = np.searchsorted(end, np.arange(1, wide + 2))
        total, chance = np.full((n, wide + 1), -np.inf), np.zeros(len(row))
        total[:, 0] = 0
        for at in range(1, wide + 1):
            cut = slice(cuts[at - 1], cuts[at])
            value = total[row[cut], start[cut]] + weight[cut]
            top = np.full(n, -np.inf)
            np.maximum.at(top, row[cut], value)
            chance[cut] = np.exp(value - top[row[cut]])
            sums = np.bincount(row[cut], chance[cut], n)
            chance[cut] /= sums[row[cut]]
            ok = sums > 0
            total[ok, at] = top[ok] + np.log(sums[ok])
        begin = self.places + np.cumsum(sizes) - sizes
        base[where] = begin
        number = begin[row] + end - 1
        order = np.argsort(number, kind="stable")
        number, chance = number[order], chance[order]
        sums = np.cumsum(chance)
        new = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        sums -= np.repeat(sums[new] - chance[new], np.diff(np.append(new, len(number))))
        self.share = np.concatenate([self.share, number + np.minimum(sums, 1)])
        self.start, self.token = np.concatenate([self.start, start[order].astype(np.int32)]), np.concatenate([self.token, token[order].astype(np.int32)])
        self.places += int(sizes.sum())

    def sample(self, texts: pa.Array, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where those of each text start, and the end)."""
        data, offsets = text_bytes(texts)
        n = len(texts)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        if len(self.share) > EDGES:
            self._clear()
        space = data == 32
        cut = data == 10
        cut[1:] |= data[:-1] == 10
        cut[1:] |= space[1:] & ~space[:-1]
        some = offsets[:-1] < offsets[1:]
        cut[offsets[:-1][some]] = True
        starts = np.flatnonzero(cut)
        before = np.searchsorted(starts, offsets)
        first = np.zeros(len(starts), np.int64)
        first[before[:-1][some]] = 1
        values = self.known.take(data, starts, np.append(starts[1:], len(data)), first)[0].reshape(-1, 2)
        base, at = values[:, 0], values[:, 1].copy()
        text = np.repeat(np.arange(n), np.diff(before))
        ids = np.asarray(keys.fill_null(-1)).astype(np.uint64)
        seed = mix(mix(ids + np.uint64(self.seed))[text] + (np.arange(len(text)) - before[:-1][text]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        live, steps, drawn = np.arange(len(text)), 0, []
        while len(live):
            u = (mix(seed[live] + np.uint64(steps)) >> np.uint64(12)).astype(np.float64) * 2.0**-52
            place = base[live] + at[live] - 1
            edge = np.searchsorted(self.share, place + u, side="right")
            # rounding must not leave the edges of this end
            edge = np.where(self.share[np.minimum(edge, len(self.share) - 1)] > place + 1, edge - 1, np.minimum(edge, len(self.share) - 1))
            drawn.append((live, self.token[edge]))
            at[live] = self.start[edge]
            live, steps = live[at[live] > 0], steps + 1
        which = np.concatenate([d[0] for d in drawn])
        count = np.bincount(which, minlength=len(text))
        ends = np.cumsum(count)
        tokens = np.zeros(int(ends[-1]), np.int64)
        for step, (rows, token) in enumerate(drawn):
            tokens[ends[rows] - 1 - step] = token
        place = np.concatenate([[0], ends])[before]
        strange = np.flatnonzero(tokens < 0)
        if len(strange):
            as_bytes = [self.pieces.byte_id[list(chr(-1 - t).encode())] for t in tokens[strange].tolist()]
            more = np.zeros(len(tokens) + 1, np.int64)
            more[strange + 1] = [len(b) - 1 for b in as_bytes]
            shift = np.cumsum(more)
            out = np.zeros(len(tokens) + int(shift[-1]), np.int64)
            out[np.arange(len(tokens)) + shift[:-1]] = tokens
            for i, b in zip((strange + shift[strange]).tolist(), as_bytes, strict=True):
                out[i : i + len(b)] = b
            tokens, place = out, place + shift[place]
        return tokens, place


def encode(docs: DataFrame, model: str | None = None, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """doc_id, ids of a sampled segmentation, and text_crc32 of the text that was encoded."""

    def make():
        sampler = Sampler(Pieces(model), alpha, seed)

        def step(batch: pa.RecordBatch) -> dict:
            tokens, place = sampler.sample(batch.column(1), batch.column(0))
            ids = pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), pa.array(tokens.astype(np.int32)))
            return {"doc_id": batch.column(0), "ids": ids, "text_crc32": batch.column(2)}

        return step

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return map_batches(docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32")), make, "doc_id long, ids array<int>, text_crc32 long")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` with ``text``."""
    from tracefold.session import with_fields

    def make():
        pieces = Pieces(model)

        def step(batch: pa.RecordBatch) -> dict:
            ids = batch.column(batch.schema.get_field_index("ids"))
            place = np.asarray(ids.offsets).astype(np.int64)
            texts = pieces.decode(np.asarray(ids.values)[place[0] : place[-1]], place - place[0])
            return {c: batch.column(i) for i, c in enumerate(batch.schema.names)} | {"text": texts}

        return step

    return map_batches(encoded, make, with_fields(encoded.schema, "text string"))


def round_trip(docs: DataFrame, model: str | None = None, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """doc_id, ids of a sampled segmentation, decoded_crc32 of the text they decode to, and lossless: whether that is the text itself.

    ``encode`` and ``decode`` in one step, so a task holds the model once and no decoded text leaves it.
    """

    def make():
        sampler = Sampler(Pieces(model), alpha, seed)

        def step(batch: pa.RecordBatch) -> dict:
            tokens, place = sampler.sample(batch.column(1), batch.column(0))
            decoded = sampler.pieces.decode(tokens, place)
            ids = pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), pa.array(tokens.astype(np.int32)))
            crc = [zlib.crc32(t) for t in decoded.cast(pa.binary()).to_pylist()]
            return {"doc_id": batch.column(0), "ids": ids, "decoded_crc32": crc, "lossless": pc.equal(decoded, batch.column(1).cast(decoded.type))}

        return step

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return map_batches(docs.select(F.col("doc_id").cast("long"), text.alias("text")), make, "doc_id long, ids array<int>, decoded_crc32 long, lossless boolean")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = round_trip(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "decoded_crc32", "lossless")


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
SQL: dict[str, str] = {}
