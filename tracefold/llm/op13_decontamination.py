r"""Benchmark decontamination by winnowing: shared fingerprints find where to look, and hits are extended to the exact words of benchmark windows.

Words are maximal runs of ``[0-9a-z]`` and non-ASCII characters after A-Z are lower-cased.  A window is ``SPAN`` consecutive words of an item; an item with fewer words, but not
none, is one window of all its words.  All is one projection of built-in functions over a document's own text, joins on what is left, and one grouping by row.

1. ``fingerprints``: hashes of ``GRAM`` consecutive words; of each ``SPAN - GRAM + 1`` neighbouring hashes the least is kept.  Two texts that share ``SPAN`` words keep the
   same least hash of that span, so every shared window has a shared fingerprint.  Windows shorter than ``SPAN`` are hashed whole, for each length that occurs.
2. The join of training and test fingerprints starts in the row: hashes of the test side are marked in a byte table (``slots``) that is a literal of the plan,
   ``SLOTS`` bytes at most, and fingerprints without a mark are dropped before anything is exploded.  Marks can be wrong, never missing.
3. Each fingerprint left is extended: the up to ``SPAN - GRAM + 1`` windows of the document around it are compared, word by word, with the windows of the items
   (``windows``, one row per distinct window with all its items).  These are broadcast up to ``BROADCAST_BYTES`` of measured text, else joined by hash.
4. Matches are totalled per row of ``docs``: the words that any matching window covers, and the items.

Null text has no words.  Rows are told apart by place: null and repeated doc_ids are reported row by row.  An item_id with several texts has the windows of all of them, a
null item_id is reported as the empty string.  Items that share a window are listed in one value, and so are those of a document.  An empty benchmark hits nothing.  Further
columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import table
from tracefold.llm.op2_quality_rules import bound
from tracefold.session import write_through

SPAN, GRAM = 10, 5
NEXT = SPAN - GRAM + 1
#: Bytes of the table of marks: at least and at most; it has MARKS slots per fingerprint in between.
LEAST_SLOTS, SLOTS, MARKS = 1 << 12, 1 << 22, 32
BROADCAST_BYTES = 100_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, NOT_WORD), lambda w: w != "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _upto(n: Column) -> Column:
    """0, 1, ... n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def grams(hashes: Column, size: int) -> Column:
    """One hash per ``size`` consecutive words."""
    return F.transform(_upto(F.size(hashes) - (size - 1)), lambda i: F.xxhash64(F.lit(size), *[F.get(hashes, i + k) for k in range(size)]))


def kept_places(hashes: Column, wanted) -> Column:
    """Places of the fingerprints of a text among its grams, of those for which ``wanted(hash)`` holds.

    A gram is kept if it is the least of any ``NEXT`` neighbours: the greatest of the least hashes of the runs it is in is its own.
    """

    def places(g: Column) -> Column:
        least = F.transform(_upto(F.size(g) - (NEXT - 1)), lambda i: F.array_min(F.slice(g, i + 1, F.lit(NEXT))))
        first = lambda p: F.greatest(p - (NEXT - 1), F.lit(0))
        own = lambda m: F.filter(_upto(F.size(g)), lambda p: wanted(F.get(g, p)) & (F.array_max(F.slice(m, first(p) + 1, p - first(p) + 1)) == F.get(g, p)))
        return bound(least, own)

    return F.when(F.size(hashes) >= SPAN, bound(grams(hashes, GRAM), places)).otherwise(F.array().cast("array<int>"))


def _texts(words: Column, starts: Column, size: int) -> Column:
    """(start, size, window) of the windows at ``starts``."""
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(size).alias("size"), F.array_join(F.slice(words, s + 1, F.lit(size)), " ").alias("window")))


def windows(items: DataFrame) -> DataFrame:
    """window, n (its words) and item_ids (sorted strings) of all distinct windows of the items."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of("text").alias("w"))
    short = F.array(F.struct(F.size("w").alias("n"), F.array_join("w", " ").alias("window")))
    full = F.transform(_upto(F.size("w") - (SPAN - 1)), lambda s: F.struct(F.lit(SPAN).alias("n"), F.array_join(F.slice("w", s + 1, F.lit(SPAN)), " ").alias("window")))
    each = rows.where(F.size("w") > 0).select("item_id", F.explode(F.when(F.size("w") < SPAN, short).otherwise(full)).alias("x")).select("item_id", "x.*")
    return each.groupBy("window", "n").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def slots(found: DataFrame) -> dict[int, tuple[bytes, int]]:
    """Marks of the test side by size of the hashed window: (bytes, their number).  ``found``: the distinct windows.

    For windows of ``SPAN`` words the fingerprints are marked, for shorter ones the hash of the whole.  The driver gets distinct slots, ``SLOTS`` numbers at most for each size.
    """
    hashes = hashed(F.split("window", " "))
    fingers = bound(hashes, lambda h: bound(grams(h, GRAM), lambda g: F.array(F.array_min(g))))
    one = lambda n: F.when(F.col("n") == n, F.array(F.xxhash64(F.lit(n), *[F.get(hashes, F.lit(k)) for k in range(n)])))
    marks = found.select("n", F.explode(F.when(F.col("n") == SPAN, fingers).otherwise(F.coalesce(*[one(n) for n in range(1, SPAN)]))).alias("h")).distinct()
    marks = write_through(marks, "marks")
    out = {}
    for row in sorted(marks.groupBy("n").count().collect()):
        wide = min(SLOTS, max(LEAST_SLOTS, 1 << (MARKS * row["count"]).bit_length()))
        taken = marks.where(F.col("n") == row["n"]).select(F.pmod("h", F.lit(wide)).cast("int").alias("s")).distinct().toPandas()["s"]
        held = bytearray(wide)
        for s in taken.tolist():
            held[s] = 1
        out[row["n"]] = bytes(held), wide
    return out


def candidates(docs: DataFrame, marks: dict[int, tuple[bytes, int]]) -> DataFrame:
    """Every row of ``docs`` (_row, doc_id, n_words), once for each (start, size, window) that may be one of an item, or once with nulls."""

    def marked(n: int):
        held, wide = marks[n]
        return lambda h: F.substring(F.lit(held), F.pmod(h, F.lit(wide)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")

    def whole(h: Column, n: int, wanted) -> Column:  # no default arguments in the lambdas: Spark would pass the index
        return bound(grams(h, n), lambda g: F.filter(_upto(F.size(g)), lambda p: wanted(F.get(g, p))))

    def look(w: Column) -> Column:
        def near(h: Column) -> list[Column]:
            last, parts = F.size(h) - SPAN, []
            if SPAN in marks:
                around = lambda p: F.sequence(F.greatest(p - (NEXT - 1), F.lit(0)), F.least(p, last))
                parts.append(_texts(w, F.array_distinct(F.flatten(F.transform(kept_places(h, marked(SPAN)), around))), SPAN))
            return parts + [_texts(w, whole(h, n, marked(n)), n) for n in sorted(set(marks) - {SPAN})]

        found = bound(hashed(w), lambda h: F.concat(*near(h))) if marks else F.lit(None).cast("array<struct<start: int, size: int, window: string>>")
        return F.struct(F.size(w).cast("long").alias("n_words"), found.alias("found"))

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), bound(words_of("text"), look).alias("x"))
    return rows.select("_row", "doc_id", "x.n_words", F.explode_outer("x.found").alias("f")).select("_row", "doc_id", "n_words", "f.*")


def _covered(spans: Column) -> Column:
    """Words covered by (start, size) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(so_far: Column, s: Column) -> Column:
        end = s["start"] + s["size"]
        more = F.greatest(end - F.greatest(so_far["end"], s["start"]), F.lit(0))
        return F.struct((so_far["n"] + more).alias("n"), F.greatest(end, so_far["end"]).alias("end"))

    return F.aggregate(F.array_sort(spans), start, step, lambda x: x["n"])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted strings) of every row."""
    known = write_through(windows(items), "windows")
    size = known.agg(F.sum(F.octet_length("window") + F.octet_length(F.array_join("item_ids", ","))).alias("b")).first()["b"] or 0
    met = candidates(docs, slots(known))
    side = known.select(F.col("window").alias("_w"), "item_ids")
    met = met.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, F.col("window") == F.col("_w"), "left")
    hit = F.when(F.col("item_ids").isNotNull(), F.struct("start", "size"))
    out = met.groupBy("_row", "doc_id", "n_words").agg(F.collect_list(hit).alias("spans"), F.collect_set("item_ids").alias("sets"))
    return out.select("doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("item_ids"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("item_ids", ","), "utf-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL_TEXT = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{NOT_WORD}'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{NOT_WORD}'), lambda w: w <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), {SPAN}) AS n, array_to_string(w[s:s + least(len(w), {SPAN}) - 1], ' ') AS win FROM i, unnest(range(1, greatest(len(w) - {SPAN}, 0) + 2)) u(s) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM wins),
dw AS (SELECT row, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM d, ns, unnest(range(1, len(w) - n + 2)) u(s) WHERE len(w) >= n),
hits AS (SELECT DISTINCT row, s, n, win FROM dw SEMI JOIN wins USING (win)),
words AS (SELECT row, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) u(p) GROUP BY row),
its AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id FROM hits JOIN wins USING (win)) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN its USING (row)
"""
QUERIES = {"op13_decontamination": op13_decontamination}
SQL = {"op13_decontamination": SQL_TEXT}
