r"""Quality rules: one table of thresholds over ratios of a text, compiled into one projection of built-in functions.

``features`` adds the counts, ``judge`` the verdict.  Null text counts as empty: no words, rejected.  The rules look at a row's text only, so null ids and
repeated rows are judged like any other; ``keep_rows`` passes all columns of ``docs`` through.

Texts are split once.  Repeated five-word windows are found per text: their 64-bit hashes are counted as a set, and only a text with a repeated one sorts (hash, place)
pairs to find which words they cover, so the work is n log n in the words of a text and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import SPACES, free_mark, table

WINDOW = 5
#: Function words of the languages, counted as whole words in lower case or with a capital.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on are this he from or an at which not "
    "der die das und ist den von zu mit ein eine im auf des dem nicht als auch es sich "
    "le la les de des et est un une en du que dans qui pour pas au sur par il "
    "el los las y del al con por una se no su para lo como que en de un"
).split()
#: Of texts with so many words at least, those are rejected where value < low or value > high; None: no bound on that side.
RULES: list[tuple[str, str, float | None, float | None, int]] = [
    ("words", "n_words", 10, None, 0),
    ("mean word length", "word_chars / n_words", 2, 12, 0),
    ("symbols per word", "n_symbols / n_words", None, 0.1, 0),
    ("upper case letters", "n_upper / word_chars", None, 0.4, 0),
    ("stop words", "n_stop_words / n_words", 0.02, None, 100),
    ("repeated lines", "n_dup_lines / n_lines", None, 0.5, 0),
    ("words in repeated windows", "n_repeat_words / n_words", None, 0.2, 0),
    ("repeats of the word before", "n_same_words / n_words", None, 0.3, 0),
]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row, also where ``use`` reads it for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""

    def covered(pairs: Column) -> Column:
        twice = lambda p, i: (p["h"] == F.get(pairs, i - 1)["h"]) | (p["h"] == F.get(pairs, i + 1)["h"])
        places = F.array_sort(F.transform(F.filter(pairs, lambda p, i: F.coalesce(twice(p, i), (p["h"] == F.get(pairs, i + 1)["h"]), (p["h"] == F.get(pairs, i - 1)["h"]), F.lit(False))), lambda p: p["i"]))
        steps = bound(places, lambda at: F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda total, s: total + s)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bound(pairs, covered)).otherwise(0)


def features(docs: DataFrame, mark: str = "__") -> DataFrame:
    """``docs`` with a struct of counts, ``f`` behind ``mark``; no column of ``docs`` begins like that."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    with_word = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")

    def windows(w: Column) -> Column:
        at = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    capital = [w[0].upper() + w[1:] for w in STOP_WORDS]

    own = {n: mark + n for n in ("words", "lines", "hashes", "windows")}
    split = docs.withColumns({own["words"]: words, own["lines"]: with_word})
    hashed = split.withColumn(own["hashes"], F.transform(own["words"], lambda w: F.xxhash64(w)))
    hashed = hashed.withColumn(own["windows"], bound(F.col(own["hashes"]), windows))
    counts = {
        "n_words": F.size(own["words"]),
        "word_chars": F.char_length(F.array_join(own["words"], "")),
        "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        "n_lines": F.size(own["lines"]),
        "n_dup_lines": F.size(own["lines"]) - F.size(F.array_distinct(own["lines"])),
        "n_repeat_words": _repeat_words(F.col(own["windows"])),
        "n_upper": F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")),
        "n_stop_words": F.size(F.filter(own["words"], lambda w: w.isin(STOP_WORDS + capital))),
        "n_same_words": bound(F.col(own["hashes"]), lambda ws: F.size(F.filter(ws, lambda w, i: (i > 0) & (w == F.get(ws, i - 1))))),
    }
    # a random column beside the counts, read by the filter of keep_rows: else the optimizer puts the counts' expressions into each condition
    return hashed.withColumns({f"{mark}f": F.struct(*[c.cast("long").alias(n) for n, c in counts.items()]), f"{mark}once": F.rand(0)}).drop(*own.values())


def judge(rules: list[tuple[str, str, float | None, float | None, int]] = RULES, mark: str = "__") -> tuple[Column, Column]:
    """(base_failed, names of the rules that reject) over the counts of ``features``; a ratio over nothing rejects nobody."""
    f = f"{mark}f"

    def value(name: str) -> Column:
        over, _, under = name.partition(" / ")
        return F.try_divide(F.col(f"{f}.{over}"), F.col(f"{f}.{under}")) if under else F.col(f"{f}.{over}").cast("double")

    def outside(rule: tuple) -> Column:
        name, of, low, high, least = rule
        wrong = F.lit(False)
        if low is not None:
            wrong |= value(of) < low
        if high is not None:
            wrong |= value(of) > high
        return F.when(wrong & (F.col(f"{f}.n_words") >= least), F.lit(name))

    base = (F.col(f"{f}.n_words") < 10) | (100 * F.col(f"{f}.n_repeat_words") > 20 * F.col(f"{f}.n_words"))
    return base, F.array_compact(F.array(*[outside(r) for r in rules]))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the names of the rules that reject."""
    base, failed = judge()
    judged = features(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "__f.*", base.alias("base_failed"), F.array_join(failed, "; ").alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def keep_rows(docs: DataFrame) -> DataFrame:
    mark = free_mark(docs)
    base, failed = judge(mark=mark)
    return features(docs, mark).where(~base & (F.size(failed) == 0) & (F.col(f"{mark}once") >= 0)).select(*docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def sql(docs: str = "documents") -> str:
    """The same in DuckDB SQL."""
    words = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    lines = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))"

    def ratio(of: str) -> str:
        over, _, under = of.partition(" / ")
        return f"({over}::DOUBLE / nullif({under}, 0))" if under else over

    tests = [f"CASE WHEN n_words >= {least} AND ({' OR '.join([f'{ratio(of)} < {low}'] * (low is not None) + [f'{ratio(of)} > {high}'] * (high is not None))}) THEN '{name}' END" for name, of, low, high, least in RULES]
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS + [w[0].upper() + w[1:] for w in STOP_WORDS]))
    return rf"""
WITH split AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {words} AS words, {lines} AS lines FROM {docs}),
windows AS (SELECT row, i, list_slice(words, i, i + {WINDOW - 1}) AS w FROM (SELECT row, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM split WHERE len(words) >= {WINDOW})),
twice AS (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS next FROM (SELECT row, i, count(*) OVER (PARTITION BY row, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT row, sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS n FROM twice GROUP BY row),
counts AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
         len(list_filter(words, lambda w: w IN ({stops}))) AS n_stop_words,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_same_words
  FROM split LEFT JOIN covered USING (row)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, array_to_string(list_filter([{', '.join(tests)}], lambda r: r IS NOT NULL), '; ') AS failed_rules FROM counts)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM judged
"""


QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL = {"op2_quality_rules": sql()}
