"""Exact token counts at every prefix of a text (SentencePiece BPE), stored so that budgets are answered without encoding again.

``token_prefixes(docs)`` returns doc_id, n_bytes, n_tokens and ``deltas``: one signed byte per code point, the change of the token count when the prefix grows by
that code point.  Running sums are the counts of all prefixes: ``tokens_at`` and ``longest_within`` read them.

A piece never holds a space after another character, and a line feed is no part of any piece, so a text falls into segments that are encoded on their own
(checked when the model is loaded).  The counts inside a segment come from ``PrefixBPE``; each task keeps those of segments seen before, at most
``CACHE`` of them.

Nulls count as empty text: 0 tokens, no deltas.  A null doc_id is returned as it is; repeated rows give repeated rows; further columns of ``docs`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import map_batches, table
from tracefold.llm.prefix_bpe import SHORT, PrefixBPE
from tracefold.llm.spans import SpanValues, text_bytes

#: Segments of which a task keeps the counts, and tokens over which a text is called long.
CACHE = 1_000_000
LIMIT = 4096
MARK = "▁"


def model_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCounts:
    """Token counts of all prefixes with a SentencePiece BPE model that has byte fallback."""

    def __init__(self, path: str | None = None, cache: int = CACHE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path(path))
        plain = {model.id_to_piece(i): i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in plain):
            raise ValueError("a piece crosses a space or a line: texts can't be cut there")
        scores = {p: -model.get_score(i) for p, i in plain.items()}
        self.bpe = PrefixBPE(plain, lambda a, b: scores.get(a + b))
        self.known = SpanValues(np.int8, cache, self._learn)

    def _alone(self, text: str) -> np.ndarray:
        counts, extra = self.bpe.one(text)[0], 0
        for i, c in enumerate(text, 1):
            extra += len(c.encode()) - 1 if c not in self.bpe.tokens else 0  # falls back to its bytes
            counts[i] += extra
        return np.diff(counts)

    def _learn(self, spans: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Changes of the count along segments; the model puts a space before the first of a text, which counts with its first character."""
        texts = [(MARK if f else "") + s.decode().replace(" ", MARK) for s, f in zip(spans, first.tolist(), strict=True)]
        codes = self.bpe.codes[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        strange = np.diff(np.concatenate([[0], np.cumsum(codes < 0)])[np.concatenate([[0], np.cumsum(sizes)])])
        plain = np.flatnonzero((strange == 0) & (sizes <= SHORT))
        out = {}
        for places, _, counts, _ in self.bpe.many([texts[i] for i in plain.tolist()]):
            out |= dict(zip(plain[places].tolist(), np.diff(counts, axis=1).astype(np.int8), strict=True))
        for i in np.flatnonzero((strange > 0) | (sizes > SHORT)).tolist():
            out[i] = self._alone(texts[i])
        values = []
        for i, (size, f) in enumerate(zip(sizes.tolist(), first.tolist(), strict=True)):
            v = out[i][:size]
            values.append(np.concatenate([[v[0] + v[1]], v[2:]]) if f else v)
        return np.concatenate(values), sizes - (first > 0)

    def deltas(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(changes of the counts over all code points of all texts, where those of each text start, and the end)."""
        data, offsets = text_bytes(texts if not pc.any(pc.match_substring(texts, MARK)).as_py() else pc.replace_substring(texts, MARK, " "))
        if not len(data):
            return np.zeros(0, np.int8), offsets
        space, line = data == 32, data == 10
        cut = line.copy()
        cut[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        before = np.searchsorted(starts, offsets)
        first = np.zeros(len(starts), np.int64)
        first[before[:-1][offsets[:-1] < offsets[1:]]] = 1
        values, place = self.known.take(data, starts, np.append(starts[1:], len(data)), first)
        return values, place[before]


def token_prefixes(docs: DataFrame, model: str | None = None) -> DataFrame:
    def make():
        counts = PieceCounts(model)

        def step(batch: pa.RecordBatch) -> dict:
            values, place = counts.deltas(batch.column(1))
            sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            deltas = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(place.astype(np.int32)), pa.py_buffer(values)])
            return {"doc_id": batch.column(0), "n_bytes": batch.column(2), "deltas": deltas, "n_tokens": pa.array(np.diff(sums[place]))}

        return step

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return map_batches(rows, make, "doc_id long, n_bytes long, n_tokens long, deltas binary")


def tokens_at(deltas: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` code points."""
    return int(np.frombuffer(deltas, np.int8)[:chars].sum(dtype=np.int64))


def longest_within(deltas: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_prefixes(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), F.length("deltas").cast("long").alias("n_prefixes"))


QUERIES = {"op7_token_counts": op7_token_counts}
SQL: dict[str, str] = {}
