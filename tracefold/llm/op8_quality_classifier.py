"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Each passage is encoded as a hidden vector, from ratios of its characters and words and from its words and
pairs of words, hashed with signs into ``BUCKETS`` sums each; a gated attention (tanh times sigmoid) says how much it counts,
and the document is scored on the weighted mean.  Only document labels are needed.  The net is small and trained here on at most ``SAMPLE`` labelled rows,
drawn by hash from those that may be learnt from; all documents are scored whole.

Inputs come from the text alone.  Null and empty texts are one passage without words and get the score of that.  Rows with a null doc_id are scored
and not held out; repeated rows get equal scores.  With no label, or labels of one kind, all scores are that kind's share (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import free_mark, map_batches, table
from tracefold.llm.labels import held_out, labelled, sample
from tracefold.llm.spans import hashes, mix, text_bytes, words

PASSAGE = 64
SAMPLE = 4000
#: Hashed sums of words, and of pairs of words, of a passage.
BUCKETS = 32
HIDDEN, GATE, STEPS = 16, 8, 300
LIMIT = 0.5


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, passages per text)."""
    data, offsets = text_bytes(texts)
    starts, ends, before = words(data, offsets)
    n = np.diff(before)
    per_text = np.maximum(1, -(-n // PASSAGE))
    first = np.cumsum(per_text) - per_text
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - before[:-1][row]
    passage = first[row] + inside // PASSAGE
    total = int(per_text.sum())
    count = np.bincount(passage, minlength=total)

    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    is_ = {
        "upper": (data >= 65) & (data <= 90) | after & (data >= 0x80) & (data <= 0x9E),
        "symbols": np.isin(data, list(b"#*$%&|<>@^~=+")), "marks": np.isin(data, list(b"!?")), "digits": (data >= 48) & (data <= 57),
        "stops": np.isin(data, list(b".,;:")), "wide": data >= 0x80,
    }

    def of_words(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return np.bincount(passage, sums[ends] - sums[starts], total)

    size = np.bincount(passage, ends - starts, total)
    h = hashes(data, starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (inside[1:] > 0)

    def repeated(group: np.ndarray, key: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, group))
        again = np.zeros(len(key), bool)
        again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
        return np.bincount(passage, again, total)

    run = h.copy()
    for k in (1, 2, 3):
        run[:-k] += mix(h[k:] + np.uint64(k))
    words_, bytes_ = np.maximum(count, 1), np.maximum(size, 1)
    features = [np.log1p(count) / 4, size / words_ / 8, *[of_words(is_[c]) / bytes_ for c in ("upper", "digits", "wide")], *[of_words(is_[c]) / words_ for c in ("symbols", "marks", "stops")]]
    features += [np.bincount(passage, same, total) / words_, repeated(passage, h) / words_, repeated(row, run) / words_]
    pairs = np.flatnonzero(passage[1:] == passage[:-1])
    hashed = [_hashed(passage, mix(h), total), _hashed(passage[pairs], mix(h[pairs] * np.uint64(3) + h[pairs + 1]), total)]
    return np.hstack([np.stack(features, axis=1), *(x / np.sqrt(words_)[:, None] for x in hashed)]), per_text


def _hashed(passage: np.ndarray, h: np.ndarray, total: int) -> np.ndarray:
    """Signed counts of hashes in ``BUCKETS`` sums per passage."""
    at = passage * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64)
    return np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), total * BUCKETS).reshape(total, BUCKETS)


class Net:
    """Gated attention over the passages of a bag, and a logistic score."""

    def __init__(self, width: int, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.w = {
            "W": draw.normal(0, 0.3, (width, HIDDEN)), "b": np.zeros(HIDDEN), "V": draw.normal(0, 0.3, (HIDDEN, GATE)), "U": draw.normal(0, 0.3, (HIDDEN, GATE)),
            "a": np.zeros(GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1),
        }
        self.mean, self.spread = np.zeros(width), np.ones(width)

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> tuple:
        w, start = self.w, np.cumsum(sizes) - sizes
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), sizes))
        weight = e / np.repeat(np.add.reduceat(e, start), sizes)
        z = np.add.reduceat(weight[:, None] * h, start)
        return x, h, t, s, weight, z, 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))

    def fit(self, x: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> "Net":
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        w, row, start = self.w, np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        share = min(max(label.mean(), 1e-3), 1 - 1e-3)
        w["d"][0] = np.log(share / (1 - share))
        m, v = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}
        for step in range(1, STEPS + 1):
            xs, h, t, s, weight, z, p = self.forward(x, sizes)
            g = (p - label) / len(label)
            dz = g[:, None] * w["c"]
            dh = weight[:, None] * dz[row]
            de = (h * dz[row]).sum(axis=1)
            de = weight * (de - np.repeat(np.add.reduceat(weight * de, start), sizes))
            dt, ds = de[:, None] * w["a"] * s * (1 - t**2), de[:, None] * w["a"] * t * s * (1 - s)
            dh = (dh + dt @ w["V"].T + ds @ w["U"].T) * (1 - h**2)
            grads = {"W": xs.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ g, "d": np.array([g.sum()])}
            for k, gk in grads.items():
                gk = gk + 1e-4 * w[k] * (k != "d")
                m[k], v[k] = 0.9 * m[k] + 0.1 * gk, 0.99 * v[k] + 0.01 * gk**2
                w[k] -= 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


def bags(docs: DataFrame, more: str = "") -> DataFrame:
    """Rows with the passages' features as one binary column; ``more``: an int column that is passed through."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            x, sizes = passages(batch.column(1))
            place = np.concatenate([[0], np.cumsum(sizes)]) * x.shape[1] * 4
            kept = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(place.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x, np.float32).tobytes())])
            return {"doc_id": batch.column(0), "bag": kept} | ({more: batch.column(2)} if more else {})

        return step

    return map_batches(docs.select("doc_id", "text", *([more] if more else [])), make, "doc_id long, bag binary" + (f", {more} int" if more else ""))


def train(docs: DataFrame, labels: DataFrame) -> Net | float:
    """The net, or a constant score where labels can't tell documents apart."""
    rows = bags(sample(labelled(docs, labels, "quality", SAMPLE), SAMPLE), "label").toArrow()
    label = np.asarray(rows["label"].combine_chunks()).astype(float)
    if len(set(label.tolist())) < 2:
        return float(label.mean()) if len(label) else 0.5
    width = passages(pa.array([""]))[0].shape[1]
    x = [np.frombuffer(b, np.float32).reshape(-1, width) for b in rows["bag"].to_pylist()]
    return Net(width).fit(np.concatenate(x).astype(float), np.array([len(b) for b in x]), label)


def score(docs: DataFrame, net: Net | float, name: str = "__score") -> DataFrame:
    """``docs`` with a column ``name``, from the column ``text``."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            x, sizes = passages(batch.column(batch.schema.get_field_index("text")).cast(pa.string()))
            p = net.forward(x, sizes)[-1] if isinstance(net, Net) else np.full(batch.num_rows, net)
            return {c: batch.column(i) for i, c in enumerate(batch.schema.names)} | {name: pa.array(p)}

        return step

    from tracefold.session import with_fields

    return map_batches(docs, make, with_fields(docs.schema, f"`{name}` double"))


def keep_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows not rejected, with all columns."""
    name = free_mark(docs) + "score"
    return score(docs, train(docs, labels), name).where(F.col(name) >= LIMIT).select(*docs.columns)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= LIMIT).cast("int").alias("predicted"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
SQL: dict[str, str] = {}
