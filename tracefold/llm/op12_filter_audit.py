r"""Filter interaction audit: what each of five filters removes in every order of applying them, with duplicates found in radix tries of whole texts.

Each document gets a mask of the filters it fails (bit i: letter i of ``FILTERS``).  A to D are one projection of built-in functions over its own text.  E, "equal to the
text of a smaller doc_id", is found in compressed tries of whole texts, whose terminals hold the least id and the rows that have it:

1. ``thin``, as rows are read: each task puts texts into a trie of at most ``TRIE_BYTES``.  A row that meets a smaller id at its terminal is a duplicate and decided; only
   the rows with the least id keep their text.  So a text that a third of all rows share goes on once per trie.
2. ``cells``: prefixes of ``HEAD`` characters name cells; a cell with over ``CELL_BYTES`` of text is cut by prefixes ``GROWTH`` times as long, and so on until each is small or
   holds a single text (those, met in very many tries, are thinned once more by cell and salt).  The cut prefixes are at most one hash of 8 bytes per
   ``CELL_BYTES`` of text and level, which is what is broadcast.
3. Cells are range-partitioned by prefix.  A task reads them in order and inserts whole texts into a trie that is emptied between cells once it holds ``TRIE_BYTES``.
   What still has the least id at its terminal at the end is no duplicate.
4. Masks are counted per doc_id, meet their labels, and are reduced to counts by (part, mask, label): at most 128 rows a part.  All orders are worked out from these.

Null text counts as empty, null lang as the part "".  A row without doc_id is no duplicate and makes none; rows that repeat doc_id and text are no duplicates of each
other.  Repeated labels count as 1 if one of them is 1.  An empty table has no parts and gives no rows.  Further columns are not read.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm.common import SPACE, SPACES, small_batches, table
from tracefold.session import write_through

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Text that a task holds in a trie, and text of a cell beyond which its prefix grows.
TRIE_BYTES, CELL_BYTES = 16_000_000, 8_000_000
HEAD, GROWTH = 16, 8
SALTS = 64
#: What a row counts besides its text.
ROW_BYTES = 32
#: Rows that a task hands back at once, and text in them.
OUT_ROWS, OUT_BYTES = 20_000, 4_000_000
ROWS = "doc_id long, part string, mask int, n long, text string"


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (filters A to D), n = 1 and text of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim("text", F.lit(SPACES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+")))
    fails = [
        F.size("_words") < 200,
        100 * F.size(F.array_distinct("_words")) < 50 * F.size("_words"),
        100 * F.char_length(F.regexp_replace("text", "[^A-Z]+", "")) > 3 * F.char_length("text"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.lit(1).cast("long").alias("n"), "text")


class Node:
    __slots__ = ("label", "kids", "least", "rows")

    def __init__(self, label: bytes):
        self.label = label
        self.kids: dict[int, Node] = {}
        self.least: int | None = None  # of a terminal: the least id, and its rows by (part, mask)
        self.rows: dict[tuple[str, int], int] | None = None


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common beginning of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed trie of texts.  ``decided`` gets (doc_id, part, mask, n) of rows that are known to be duplicates."""

    def __init__(self, decided: Callable[[int, str, int, int], None]):
        self.root, self.size, self.decided = Node(b""), 0, decided

    def terminal(self, text: bytes) -> Node:
        node, at, end = self.root, 0, len(text)
        while at < end:
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text[at:])
                self.size += end - at
                return kid
            if text.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                continue
            cut = common(kid.label, text, at)
            upper = node.kids[text[at]] = Node(kid.label[:cut])
            kid.label = kid.label[cut:]
            upper.kids[kid.label[0]] = kid
            node, at = upper, at + cut
        return node

    def add(self, text: bytes, doc_id: int, part: str, mask: int, n: int) -> None:
        at = self.terminal(text)
        if at.least is None or doc_id < at.least:
            for (p, m), k in (at.rows or {}).items():
                self.decided(at.least, p, m | DUPLICATE, k)
            at.least, at.rows = doc_id, {(part, mask): n}
        elif doc_id == at.least:
            at.rows[part, mask] = at.rows.get((part, mask), 0) + n
        else:
            self.decided(doc_id, part, mask | DUPLICATE, n)

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        """(text, terminal) of all texts."""
        stack = [(self.root, b"")]
        while stack:
            node, above = stack.pop()
            text = above + node.label
            if node.least is not None:
                yield text, node
            stack.extend((kid, text) for kid in node.kids.values())


def _tries(rows: DataFrame, last: bool, cell: str | None = None) -> DataFrame:
    """``rows`` through tries, one task's rows in their order.  Rows decided lose their text; with ``last`` all are decided.

    A trie is emptied once it holds ``TRIE_BYTES``: with ``cell`` only between two values of it, so that all rows of a cell are in one trie.
    """
    columns = ["doc_id", "part", "mask", "n", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.string())])
        out: list[tuple] = []
        held = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)

        def decide(*row) -> None:
            out.append((*row, None))

        def rest(trie: Trie) -> Iterator[pa.RecordBatch]:
            nonlocal out, held
            for text, at in trie.terminals():
                for (part, mask), n in at.rows.items():
                    out.append((at.least, part, mask, n, None if last else text.decode()))
                    held += 0 if last else len(text)
                if len(out) >= OUT_ROWS or held >= OUT_BYTES:
                    yield batch_of(out)
                    out, held = [], 0

        trie, now = Trie(decide), None
        for batch in (b for whole in batches for b in small_batches(whole)):
            cells = batch.column(len(columns)).to_pylist() if cell else [None] * batch.num_rows
            for doc_id, part, mask, n, text, at in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4).cast(pa.binary()).to_pylist(), cells, strict=True):
                if trie.size >= TRIE_BYTES and (not cell or at != now):
                    yield from rest(trie)
                    trie = Trie(decide)
                now = at
                if doc_id is None:  # compares with nothing
                    out.append((None, part, mask, n, None))
                else:
                    trie.add(text, doc_id, part, mask, n)
            if len(out) >= OUT_ROWS:
                yield batch_of(out)
                out = []
        yield from rest(trie)
        if out:
            yield batch_of(out)

    return rows.select(*columns, *([cell] if cell else [])).mapInArrow(run, ROWS)


def cells(rows: DataFrame) -> DataFrame:
    """``rows`` with ``cell``, the hash of the shortest prefix that names few texts, and ``single``: the prefix is the whole text."""
    size = HEAD
    prefix = lambda n: F.xxhash64(F.lit(n), F.substring("text", 1, n))
    out = rows.withColumns({"cell": prefix(size), "single": F.char_length("text") <= size})
    while True:
        large = out.where("NOT single").groupBy(F.col("cell").alias("_cell")).agg(F.sum(F.octet_length("text") + ROW_BYTES).alias("_bytes")).where(F.col("_bytes") > CELL_BYTES)
        large = write_through(large.select("_cell"), "prefixes")
        if large.isEmpty():
            return out
        size *= GROWTH
        # one row per CELL_BYTES of text at most
        marked = out.join(F.broadcast(large), F.col("cell") == F.col("_cell"), "left")
        cut = F.col("_cell").isNotNull() & ~F.col("single")
        marked = marked.withColumn("cell", F.when(cut, prefix(size)).otherwise(F.col("cell")))
        out = marked.withColumn("single", F.when(cut, F.char_length("text") <= size).otherwise(F.col("single"))).drop("_cell")


def duplicates(rows: DataFrame) -> DataFrame:
    """doc_id, part, mask with the bit of E, and n: rows of ``masks`` that agree in the first three may be taken together."""
    read = write_through(_tries(rows, last=False), "thinned")
    decided = read.where("text IS NULL")
    open_ = cells(read.where("text IS NOT NULL"))
    heavy = open_.where("single").groupBy(F.col("cell").alias("_cell")).agg(F.sum(F.octet_length("text") + ROW_BYTES).alias("_bytes")).where(F.col("_bytes") > CELL_BYTES)
    heavy = write_through(heavy.select("_cell"), "texts")
    if not heavy.isEmpty():  # one text in very many tries
        marked = open_.join(F.broadcast(heavy), F.col("cell") == F.col("_cell"), "left").withColumn("_heavy", F.col("_cell").isNotNull() & F.col("single"))
        dealt = marked.where("_heavy").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        again = write_through(_tries(dealt.repartition("cell", "_salt").sortWithinPartitions("cell"), last=False, cell="cell"), "thinned")
        decided = decided.unionByName(again.where("text IS NULL"))
        kept = cells(again.where("text IS NOT NULL")).select("doc_id", "part", "mask", "n", "text", "cell")
        open_ = marked.where("NOT _heavy").select(*kept.columns).unionByName(kept)
    ranged = open_.select("doc_id", "part", "mask", "n", "text", "cell", F.substring("text", 1, HEAD).alias("_head")).repartitionByRange("_head", "cell").sortWithinPartitions("_head", "cell")
    return decided.unionByName(_tries(ranged, last=True, cell="cell")).drop("text")


def reduced(found: DataFrame, labels: DataFrame) -> DataFrame:
    """n by part, mask, good and toxic."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    per = found.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    met = per.join(known, "doc_id", "left").fillna(False, ["good", "toxic"])
    return met.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def orders(filters: str = FILTERS) -> list[dict]:
    """Every step of every order: its filter's bit and the bits of those before it."""
    out = []
    for order in itertools.permutations(filters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << filters.index(letter)
            out.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return out


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step from counts by part, mask, good and toxic."""
    steps = F.from_json(F.lit(json.dumps(orders(filters))), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    each = counts.select("*", F.explode(steps).alias("s")).select("*", "s.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    per = each.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~gone & F.col("good")).alias("good_lost"),
        total(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    return per.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicates(masks(table(spark, sf_dir, "documents")))
    return audit(write_through(reduced(found, table(spark, sf_dir, "labels")), "masks"))


SQL_TEXT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
m AS (SELECT doc_id, part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
             + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
             + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f(i) AS (VALUES (0), (1), (2), (3), (4)),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS x FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(x, lambda i: chr(65 + i)), '') AS filter_order, step::INTEGER AS step, (1 << x[step]) AS bit,
             coalesce(list_sum(list_transform(x[:step - 1], lambda i: (1 << i))), 0)::INTEGER AS before FROM o, unnest(range(1, 6)) u(step)),
r AS (SELECT part, filter_order, step, bit, (sum(n) FILTER (mask & (bit | before) = 0)) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed,
             sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
             sum(n) FILTER (mask & bit <> 0 AND mask & before = 0 AND good) AS good_lost, sum(n) FILTER (mask & bit <> 0 AND mask & before = 0 AND toxic) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r
"""
QUERIES = {"op12_filter_audit": op12_filter_audit}
SQL = {"op12_filter_audit": SQL_TEXT}
