"""Packing of documents into sequences of a fixed number of tokens: shortest pack first over the histogram of lengths.

1. Each document becomes token ids plus an end id, cut into pieces of at most ``ROOM`` ids (``pieces``).
2. Only the histogram of piece lengths, at most ``ROOM`` numbers, reaches the driver.  ``pack_lengths`` places lengths, longest first, always into the pack with
   the most room left, and counts how often each pattern of lengths occurs.
3. Patterns give every length intervals of ranks; a piece finds its sequence and offset by its rank among the pieces of its length (``assign``).  Ranks come from
   counts of hashed buckets, so no length is ranked in one task.
4. ``sequences`` brings the ids of a sequence together, ``ROOM`` ids at most.

Null texts count as empty: the end id alone.  Rows with a null doc_id and repeated rows are packed as documents of their own.  Further columns are not read.
Ids are cut into pieces in the task that reads a text; a worker process keeps the encodings of words it has seen, at most ``CACHE`` of them, and which tokens may
follow each other, for all its tasks.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm.common import map_batches, table
from tracefold.llm.prefix_bpe import SHORT, PrefixBPE
from tracefold.llm.spans import SpanValues, text_bytes, words
from tracefold.session import with_fields, write_through

ROOM = 2048
END_ID = 1
#: Words whose ids a worker process keeps, and buckets into which the pieces of one length are dealt for ranking.
CACHE = 600_000
BUCKETS = 1024
#: Bytes of text encoded at once; words not seen before take many times their size meanwhile.
STEP = 500_000
WORD_END = ""


def tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts under a tokenizer that works word by word: words of letters by ``PrefixBPE``, all else by the tokenizer itself, each text between
    white space once."""

    def __init__(self, path: str | None = None, cache: int = CACHE):
        from tokenizers import Tokenizer

        path = tokenizer_path(path)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]

        def own(token: str) -> str:
            return token.removesuffix(suffix) + WORD_END if token.endswith(suffix) else token

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {(own(a), own(b)): i for i, (a, b) in enumerate(pairs)}
        vocab = {own(t): i for t, i in model["vocab"].items() if own(t) != WORD_END}
        self.bpe = PrefixBPE(vocab, lambda a, b: ranks.get((a, b)), WORD_END)
        # byte-level alphabet: visible bytes stand for themselves, the others follow from 256 on
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = dict(zip(visible + hidden, map(chr, visible + list(range(256, 256 + len(hidden)))), strict=True))
        self.sizes = np.zeros(self.bpe.base, np.int64)
        for t, i in vocab.items():
            self.sizes[i] = len(t)
        self.limit, self.words = cache, {}
        self.known = SpanValues(np.uint32, cache, self._learn)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _learn_words(self, words: list[str]) -> None:
        spelled = [w.encode("utf-8").decode("latin-1").translate(self.letters) + WORD_END for w in words]
        short = [i for i, s in enumerate(spelled) if len(s) <= SHORT]
        for i in set(range(len(words))).difference(short):
            self.words[words[i]] = self._whole(words[i])
        for places, sizes, counts, last in self.bpe.many([spelled[i] for i in short]):
            rows = np.arange(len(places))
            left, at = counts[rows, sizes].astype(np.int64), sizes.copy()
            ends = np.cumsum(left)
            out, write = np.zeros(int(ends[-1]), np.uint32), ends - 1
            while len(rows):
                token = last[rows, at]
                out[write] = token
                at = at - self.sizes[token]
                more = at > 0
                rows, at, write = rows[more], at[more], write[more] - 1
            whole, start = out.tobytes(), 0
            for place, end in zip(places.tolist(), (ends * 4).tolist(), strict=True):
                self.words[words[short[place]]] = whole[start:end]
                start = end

    def _learn(self, spans: list[bytes], _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > self.limit // 4:
            self.words = {}
        self.words[""] = b""
        parts, odd = [], {}
        for i, span in enumerate(spans):
            text = span.decode()
            head = text.rstrip(".,;:!?")
            # letters whose case and composition all Unicode versions agree on
            if head.isalpha() and (head.isascii() or max(head) < "\u0370"):
                word = head.lower() if head.isascii() else unicodedata.normalize("NFC", head).lower()
                if word.isalpha():
                    parts.append((word, text[len(head) :]))
                    continue
            odd[i] = text
            parts.append(("", ""))
        self._learn_words(list({w for w, _ in parts}.difference(self.words)))
        for tail in {t for _, t in parts}.difference(self.words):
            self.words[tail] = self._whole(tail)
        words = self.words
        out = [words[w] + words[t] for w, t in parts]
        for i, e in zip(odd, self.tokenizer.encode_batch_fast(list(odd.values()), add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32).tobytes()
        return np.frombuffer(b"".join(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where those of each text start, and the end)."""
        data, offsets = text_bytes(texts)
        starts, ends, before = words(data, offsets)
        values, place = self.known.take(data, starts, ends)
        return values, place[before]


@lru_cache(maxsize=1)
def word_ids(path: str | None) -> WordIds:
    """The encoder of this worker process."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids_crc32 and, if asked for, ids (four bytes each) of all pieces."""

    def make():
        encode = word_ids(tokenizer)

        def step(batch: pa.RecordBatch) -> dict:
            values, place = encode.ids(batch.column(1))
            sizes = np.diff(place) + 1
            cuts = -(-sizes // ROOM)
            row = np.repeat(np.arange(len(sizes)), cuts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * ROOM
            length = np.minimum(sizes[row] - start, ROOM)
            whole = np.insert(values, place[1:], END_ID).tobytes()  # an end id after the ids of each text
            ends = np.cumsum(length) * 4
            ids = [whole[a:b] for a, b in zip((ends - length * 4).tolist(), ends.tolist(), strict=True)]
            out = {"doc_id": batch.column(0).take(pa.array(row)), "start": pa.array(start), "length": pa.array(length), "doc_tokens": pa.array(sizes[row]), "ids_crc32": [zlib.crc32(i) for i in ids]}
            return out | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {})

        return step

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, make, "doc_id long, start long, length long, doc_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else ""), STEP)


def pack_lengths(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(how often, ((length, times), ...)) of each pattern.  The work depends on the number of lengths, not on that of pieces."""
    open_: dict[int, list[tuple[int, tuple]]] = {}  # by room left
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        for space in sorted((s for s in open_ if s >= size), reverse=True):
            held, times = open_[space], space // size
            while left and held:
                count, pattern = held.pop()
                full = min(count, left // times)
                if full < count:
                    held.append((count - full, pattern))
                if full:
                    open_.setdefault(space - times * size, []).append((full, (*pattern, (size, times))))
                    left -= full * times
                if full < count and left:  # fewer than one pack takes
                    count, pattern = held.pop()
                    if count > 1:
                        held.append((count - 1, pattern))
                    open_.setdefault(space - left * size, []).append((1, (*pattern, (size, left))))
                    left = 0
            if not left:
                break
        times = room // size
        if left >= times:
            open_.setdefault(room - times * size, []).append((left // times, ((size, times),)))
        if left % times:
            open_.setdefault(room - left % times * size, []).append((1, ((size, left % times),)))
    return sorted((p for held in open_.values() for p in held), key=lambda p: p[1], reverse=True)


def slots(patterns: list[tuple[int, tuple]]) -> tuple[np.ndarray, ...]:
    """Per interval of ranks: length, first rank, packs, first sequence, offset; sorted by (length, first rank)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for size, times in pattern:
            # ranks in turn: the pieces of one length in one pack follow each other
            rows.append((size, taken.get(size, 0), times, sequence, offset))
            taken[size] = taken.get(size, 0) + count * times
            offset += size * times
        sequence += count
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 5).T)


def assign(cut: DataFrame) -> DataFrame:
    """``cut`` (pieces) with sequence_id and offset.  ``cut`` is read three times: hand over a written table."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table_ = spark.sparkContext.broadcast(slots(pack_lengths(histogram)))
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(F.col("length").alias("_l"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    counts = counts.select("_l", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(counts, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.select(*cut.columns, "_rank")
    schema = with_fields(cut.schema, "sequence_id long, offset long")

    def make():
        size, first, times, sequence, offset = table_.value
        order = size * (1 << 50) + first

        def step(batch: pa.RecordBatch) -> dict:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "_rank"))
            at = np.searchsorted(order, length * (1 << 50) + rank, side="right") - 1
            pack, place = np.divmod(rank - first[at], times[at])
            out = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            return out | {"sequence_id": pa.array(sequence[at] + pack), "offset": pa.array(offset[at] + place * length)}

        return step

    return map_batches(ranked, make, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of every sequence, from packed pieces that kept their ids."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
    ids = F.aggregate("p", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    return held.select("sequence_id", "length", ids.alias("ids"))


def pack(docs: DataFrame, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    return assign(write_through(pieces(docs, tokenizer, keep_ids), "pieces"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the digest is that of the ids which arrive in their sequence
    return pack(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {"op6_packing": op6_packing}
SQL: dict[str, str] = {}
