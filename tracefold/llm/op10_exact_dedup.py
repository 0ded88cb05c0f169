"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text.

Texts are equal when they are identical without white space.  A row whose length no other row has is single; of the others, a row whose (length, prefix hash) no other
row has is single; only what is left is grouped by its SHA-256.  With ``digests=False`` that hash is taken of rows still in question only; with ``digests=True``
each row carries its hash, as a caller who wants every digest needs the full content of every row anyway.  Lengths, prefixes and hashes that very many rows share are
counted in salted pieces.  ``keep_rows`` hashes the content of rows in question once, and sends one row per task and text to where equal texts meet.

Of equal texts the row with the most code points stays, then that with the smallest doc_id (null comes last).  Null text counts as empty; all
empty texts are equal.  Rows that share doc_id and text are all marked as kept if that doc_id stays (``keep_rows`` leaves one of them).  Further columns of ``docs``
are not read by ``exact_groups`` and pass through ``keep_rows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import SPACE, free_mark, group_values, table
from tracefold.session import write_through

#: Characters of the normalised text that the second step hashes.
PREFIX = 64


def _features(docs: DataFrame, digests: bool) -> DataFrame:
    """What the steps compare, in one pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = docs.select(F.col("doc_id").cast("long"), F.char_length(text).cast("long").alias("chars"), F.regexp_replace(text, SPACE + "+", "").alias("bare"))
    return bare.select(
        "doc_id", "chars", F.octet_length("bare").alias("size"), F.xxhash64(F.substring("bare", 1, PREFIX)).alias("prefix"),
        *([F.sha2(F.encode("bare", "utf-8"), 256).alias("text_sha256")] if digests else [F.col("bare")]),
    )


def _count(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with the number of rows that share ``keys``."""
    return group_values(rows, keys, {"part": F.count("*")}, {name: F.sum("_part")}, ["doc_id", "chars"])


def _open_keys(rows: DataFrame) -> DataFrame:
    """(size, prefix) that several rows have; lengths that only one has are left out before prefixes are looked at."""
    lengths = rows.groupBy("size").count().where("count > 1").select("size")
    return rows.join(lengths, "size", "left_semi").groupBy("size", "prefix").count().where("count > 1").drop("count")


def exact_groups(docs: DataFrame, digests: bool = True) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (null for rows found single before if not ``digests``), chars."""
    rows = _features(docs, digests)
    if digests:
        rows = write_through(rows, "features")
    if not digests:
        # what the steps need stays small: the texts are hashed where they are read, once it is known which
        keys = _open_keys(write_through(rows.select("size", "prefix"), "lengths")).withColumn("_open", F.lit(True))
        marked = rows.join(keys, ["size", "prefix"], "left")
        rows = write_through(marked.withColumn("text_sha256", F.when(F.col("_open"), F.sha2(F.encode("bare", "utf-8"), 256))).drop("bare", "_open"), "features")
    lengths = write_through(_count(rows, ["size"], "_lengths"), "lengths")
    prefixes = write_through(_count(lengths.where("_lengths > 1").drop("_lengths"), ["size", "prefix"], "_prefixes"), "prefixes")
    open_ = prefixes.where("_prefixes > 1")
    single = lengths.where("_lengths = 1").drop("_lengths").unionByName(prefixes.where("_prefixes = 1").drop("_prefixes"))
    best = F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    alike = group_values(
        open_.withColumn("_best", best), ["text_sha256"], {"size": F.count("*"), "best": F.min("_best")},
        {"_first": F.min("_best"), "group_size": F.sum("_size")}, ["doc_id", "chars"],
    )
    alike = alike.select("doc_id", F.col("_first.doc_id").alias("keep_id"), "group_size", (F.col("_best") == F.col("_first")).alias("kept"), "text_sha256", "chars")
    single = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "chars")
    return alike.unionByName(single)


def keep_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    mark = free_mark(docs)
    size, prefix, whole, open_ = (mark + n for n in ("size", "prefix", "whole", "open"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    bare = F.regexp_replace(text, SPACE + "+", "")
    marked = docs.withColumns({size: F.octet_length(bare), prefix: F.xxhash64(F.substring(bare, 1, PREFIX))})
    keys = _open_keys(write_through(marked.select(F.col(size).alias("size"), F.col(prefix).alias("prefix")), "lengths"))
    keys = write_through(keys.select(F.col("size").alias(size), F.col("prefix").alias(prefix), F.lit(True).alias(open_)), "open")
    marked = marked.join(keys, [size, prefix], "left")
    single = marked.where(F.col(open_).isNull())
    # equal texts: the best row of each task first, then the best of these
    best = F.struct(-F.char_length(text), docs["doc_id"].cast("long").isNull(), docs["doc_id"].cast("long"))
    equal = marked.where(F.col(open_)).groupBy(F.sha2(F.encode(bare, "utf-8"), 256).alias(whole)).agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), best).alias(open_))
    return single.select(*docs.columns).unionByName(equal.select(f"{open_}.*"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: DuckDB SQL over ``documents``; also used by the pipeline.
GROUPS = r"""
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER best AND chars = first_value(chars) OVER best AS kept, text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
QUERIES = {"op10_exact_dedup": op10_exact_dedup}
SQL = {"op10_exact_dedup": GROUPS}
