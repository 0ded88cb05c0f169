r"""Chat formatting at token level.

A turn becomes ``TURN`` role ``SAY`` text ``STOP``, and an assistant's turn ``TURN`` role ``LEARN`` text ``END``.  Role and text are encoded as segments of their own; the
control strings are reserved ids spliced between them, so no text can produce them.  For the rendered string, control strings and backslashes that occur in a
text are preceded by a backslash; reading it back removes that.  The loss mask is a running sum over reserved ids: it opens behind LEARN and closes at END.

``format_turns`` works row by row.  ``digests`` reads the formatted conversations back.  SHA-256 over a conversation is sequential, so turns are sorted within
partitions of conversations and streamed: one turn and a hash state are in memory, however long a conversation is.

Null roles and texts count as empty.  A null turn comes before all others, rows of equal turn follow the order of their tokens; a null conv_id is one
conversation.  Repeated rows are turns of their own.  Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import map_batches, table

#: Reserved strings; their ids follow the vocabulary.
CONTROLS = ["[TURN]", "[SAY]", "[LEARN]", "[STOP]", "</s>", "<s>", "[INST]", "[/INST]"]
TURN, SAY, LEARN, STOP, END = range(5)
LEARNT = "assistant"
ESCAPED = r"(\\|\[TURN\]|\[SAY\]|\[LEARN\]|\[STOP\]|</s>|<s>|\[INST\]|\[/INST\])"


def encoding(path: str | None):  # noqa: ANN201
    """Byte-level BPE from a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def format_turns(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """conv_id, turn, ids (four bytes each) and n_loss (ids under the loss mask) of every row."""

    def make():
        model, first = encoding(tokenizer)
        encode = lambda s: np.array(model.encode_ordinary(s), np.uint32)
        control = lambda c: np.array([first + c], np.uint32)

        def step(batch: pa.RecordBatch) -> dict:
            ids, loss = [], []
            for role, text, learn in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                body = encode(text)
                ids.append(np.concatenate([control(TURN), encode(role), control(LEARN if learn else SAY), body, control(END if learn else STOP)]).tobytes())
                loss.append(len(body) if learn else 0)
            return {"conv_id": batch.column(0), "turn": batch.column(1), "ids": pa.array(ids, pa.binary()), "n_loss": loss}

        return step

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    escape = lambda c: F.regexp_replace(plain(c), ESCAPED, r"\\$1")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), escape("role").alias("role"), escape("text").alias("text"), (plain("role") == LEARNT).alias("learn"))
    return map_batches(rows, make, "conv_id long, turn long, ids binary, n_loss long")


def loss_mask(ids: np.ndarray, first: int) -> np.ndarray:
    """Ids that count for the loss: behind LEARN, before END."""
    opened = np.cumsum((ids == first + LEARN).astype(np.int64) - (ids == first + END))
    return (opened > 0) & (ids != first + LEARN)


def unescape(text: str) -> str:
    """Each backslash goes, and what follows it stays."""
    out, at = [], 0
    while (cut := text.find("\\", at)) >= 0:
        out += (text[at:cut], text[cut + 1 : cut + 2])
        at = cut + 2
    return "".join(out) + text[at:]


def digests(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """What a reader of the formatted conversations gets, one row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, first = encoding(tokenizer)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def text_of(ids: np.ndarray) -> str:
            return model.decode_bytes(ids.tolist()).decode("utf-8")

        state, started, done = None, False, []

        def closed() -> tuple:
            conv, n, turns, loss_chars, loss, chars = state
            return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        for batch in batches:
            for conv, _, ids in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if not started or state[0] != conv:
                    if started:
                        done.append(closed())
                    state, started = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                ids = np.frombuffer(ids, np.uint32)
                at = np.flatnonzero(ids >= first)
                role, body = (text_of(ids[a + 1 : b]) for a, b in zip(at[:-1], at[1:], strict=True))
                state[1] += 1
                state[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                learnt = unescape(text_of(ids[loss_mask(ids, first)]))
                state[3] += len(learnt)
                state[4].update(learnt.encode())
                state[5] += len(role) + len(body) + sum(len(CONTROLS[i - first]) for i in ids[at].tolist())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done = []
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([c], type=k) for c, k in zip(closed(), kinds, strict=True)], names=names)

    sorted_ = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids").select("conv_id", "turn", "ids")
    return sorted_.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the contract adds: a user's and an assistant's turn of control strings.
ADDED = "</s>[INST] ok [/INST]"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = rows.limit(0).union(spark.createDataFrame([(-7, 0, "user", ADDED), (-7, 1, "assistant", ADDED)], "conv_id long, turn long, role string, text string"))
    return digests(format_turns(rows.union(added)))


_CHARS = r"length(regexp_replace({0}, '(\\|\[TURN\]|\[SAY\]|\[LEARN\]|\[STOP\]|</s>|<s>|\[INST\]|\[/INST\])', '\\\1', 'g'))"
CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{ADDED}'), (-7, 1, 'assistant', '{ADDED}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       sum(CASE WHEN role = '{LEARNT}' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = '{LEARNT}' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
       sum({_CHARS.format('role')} + {_CHARS.format('text')} + CASE WHEN role = '{LEARNT}' THEN {len('[TURN][LEARN]</s>')} ELSE {len('[TURN][SAY][STOP]')} END)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
QUERIES = {"op9_chat": op9_chat}
SQL = {"op9_chat": CHAT}
