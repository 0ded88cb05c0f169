"""Toxicity: Levenshtein automata intersected with a trie of learnt terms, and scores of the context of each hit.

1. ``lexicon``: over all rows that may be learnt from, words and beginnings of words are counted in toxic and in other documents.  Terms in ``LEAST`` toxic
   documents or more that are ``LIFT`` times as frequent there are kept, however many these are.  A beginning of which one kept word makes up ``WHOLE`` is that
   word and goes, of the others the shortest stay.  Every kept word stays, so that one edit is found in words under a beginning as well.
2. ``Automaton``: the trie of the terms and a Levenshtein automaton of one edit, intersected and made deterministic as words are read.  A whole term of five
   letters or more is also found with one edit, a beginning only as it is.  A lexicon of more than ``TERMS`` terms is not sent to the tasks: its trie is cut into
   parts, by the first two letters and once more by the last two, and the distinct words of the texts meet the parts that can hold terms near them (``_found``).
   Texts are split into words as the lexicon is, at everything that is no letter.
3. A hit counts as quoted between two quotation marks (" “ ” „ « ») at most ``QUOTE`` words apart, or shortly after a word of reporting; plain, quoted, exact and misspelt hits are separate inputs of a
   logistic regression, fitted on at most ``SAMPLE`` labelled rows.

Null and empty texts have no hits and get the lowest score.  Rows with a null doc_id are scored and not held out; repeated rows get equal scores.  Without labels of both
kinds there is no lexicon and all scores are 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import map_batches, table
from tracefold.llm.labels import held_out, labelled, sample
from tracefold.llm.spans import SpanValues, text_bytes, words
from tracefold.session import write_through

SAMPLE = 20_000
LEAST, LIFT, WHOLE = 5, 30.0, 0.8
BEGIN, UPTO, FUZZY = 4, 7, 5
BEFORE, QUOTE = 5, 30
CACHE = 500_000
#: Terms that tasks hold as a trie, and states of the automaton that they keep.
TERMS, STATES = 20_000, 50_000
LIMIT = 0.7
#: Words after which a term is taken as reported speech.
REPORTING = set("said says say called calls quoted quote wrote writes word term sagte sagt nannte dit appelle dijo dice llamó".split())


def _terms(rows: DataFrame) -> DataFrame:
    """One row per document and distinct term, with its label: ``w:`` words, ``p:`` beginnings of longer words."""
    found = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda w: F.char_length(w) >= BEGIN)
    parts = [F.transform("w", lambda w: F.concat(F.lit("w:"), w))]

    def begin(n: int) -> Column:  # no default arguments in the lambdas: Spark would pass the index
        return F.transform(F.filter("w", lambda w: F.char_length(w) > n), lambda w: F.concat(F.lit("p:"), F.substring(w, 1, n)))

    parts += [begin(n) for n in range(BEGIN, UPTO + 1)]
    return rows.select("label", found.alias("w")).select("label", F.explode(F.array_distinct(F.concat(*parts))).alias("term"))


def _heads(word: Column, upto: Column) -> Column:
    """The beginnings of a word that terms can be, of at most ``upto`` letters."""
    return F.array_compact(F.array(*[F.when(upto >= n, F.concat(F.lit("p:"), F.substring(word, 1, n))) for n in range(BEGIN, UPTO + 1)]))


def lexicon(rows: DataFrame) -> DataFrame:
    """(term, weight), "w:" and the word or "p:" and the beginning, from (text, label)."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    seen = _terms(rows.where("label IN (0, 1)")).groupBy("term").agg(F.sum("label").alias("t"), F.count("*").alias("n")).where(F.col("t") >= LEAST)
    lift = (F.col("t") + 0.5) / (toxic + 1) * (clean + 1) / (F.col("n") - F.col("t") + 0.5)
    # without rows of both kinds nothing tells them apart
    kept = write_through(seen.select("term", "t", lift.alias("lift")).where((F.col("lift") >= LIFT) & F.lit(bool(toxic and clean))), "terms")
    weight = F.log("lift").alias("weight")
    word = F.substring("term", 3, 1_000_000)
    words_ = kept.where("term LIKE 'w:%'")
    most = words_.select("t", F.explode(_heads(word, F.char_length(word) - 1)).alias("term")).groupBy("term").agg(F.max("t").alias("most"))
    heads = kept.where("term LIKE 'p:%'").join(most, "term", "left").where(F.coalesce("most", F.lit(0)) < WHOLE * F.col("t"))
    shorter = heads.select(F.col("term").alias("_h"))
    covered = heads.select("term", F.explode(_heads(word, F.char_length(word) - 1)).alias("_h")).join(shorter, "_h").select("term")
    return write_through(words_.select("term", weight).unionByName(heads.join(covered, "term", "left_anti").select("term", weight)), "lexicon")


class Automaton:
    """Terms by reading a word: states are sets of (trie node, edits so far)."""

    def __init__(self, terms: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.word, self.head, self.near, self.fuzzy = {}, {}, {}, set()
        for term, weight in terms.items():
            path = [0]
            for c in term[2:]:
                path.append(self.next[path[-1]].setdefault(c, len(self.next)))
                if path[-1] == len(self.next):
                    self.next.append({})
            (self.word if term[0] == "w" else self.head)[path[-1]] = weight
            if term[0] == "w" and len(term) - 2 >= FUZZY:
                self.fuzzy.update(path)
                self.near[path[-1]] = weight
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.values: list[tuple[float, float]] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, items: set) -> frozenset:
        """With missing letters: a step in the trie that reads nothing."""
        more = {(n, 1) for node, k in items if k == 0 and node in self.fuzzy for n in self.next[node].values() if n in self.fuzzy}
        return frozenset(items | more)

    def _state(self, items: frozenset) -> int:
        if items not in self.ids:
            self.ids[items] = len(self.sets)
            self.sets.append(items)
            self.moves.append({})
            exact = max((w for node, k in items if k == 0 for w in (self.word.get(node, 0),)), default=0)
            near = max((self.near.get(node, 0) for node, k in items if k == 1), default=0)
            self.values.append((exact, near))
        return self.ids[items]

    def _step(self, state: int, c: str) -> int:
        items = set()
        for node, k in self.sets[state]:
            if c in self.next[node]:
                items.add((self.next[node][c], k))
            if k == 0 and node in self.fuzzy:
                items.add((node, 1))  # a letter too many
                items.update((n, 1) for n in self.next[node].values() if n in self.fuzzy)  # another letter
        items = {(n, k) for n, k in items if k == 0 or n in self.fuzzy}
        found = self.moves[state][c] = self._state(self._closed(items))
        return found

    def read(self, word: str) -> tuple[float, float]:
        """(weight of an exact hit, weight of a misspelt one); 0: none."""
        if len(self.sets) > STATES:
            self._clear()
        state, node, head = self.start, 0, 0.0
        for c in word:
            state = self.moves[state][c] if c in self.moves[state] else self._step(state, c)
            if node is not None:
                node = self.next[node].get(c)
                head = max(head, self.head.get(node, 0.0))
            if not self.sets[state]:
                return head, 0.0
        exact, near = self.values[state]
        exact = max(exact, head)
        return exact, 0.0 if exact else near


def terms_of(span: bytes) -> list[str]:
    """The words that are looked for in a span between white space: its runs of letters in lower case, as the lexicon is split.  Single letters that are kept
    apart by other characters are taken as one word."""
    word = span.decode().lower()
    if word.isalpha():
        return [word]
    runs = "".join(c if c.isalpha() else " " for c in word).split()
    return ["".join(runs)] if len(runs) > 1 and all(len(r) == 1 for r in runs) else runs


def quotations(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether words stand between two quotation marks that are at most ``QUOTE`` words apart; a mark without a partner that near, such as an inch sign, counts for nothing."""
    after = lambda k, b: np.concatenate([data[k:] == b, np.zeros(min(k, len(data)), bool)])
    low = (data == 0xE2) & after(1, 0x80) & (after(2, 0x9C) | after(2, 0x9D) | after(2, 0x9E))
    at = np.flatnonzero((data == 34) | low | ((data == 0xC2) & (after(1, 0xAB) | after(1, 0xBB))))
    inside = np.zeros(len(starts), bool)
    if len(at) < 2 or not len(starts):
        return inside
    word = np.searchsorted(starts, at, side="right") - 1
    text = np.searchsorted(offsets, at, side="right").tolist()
    first = (word + (at != starts[np.maximum(word, 0)])).tolist()  # a mark behind letters opens with the next word
    word, k = word.tolist(), 0
    while k + 1 < len(word):
        if text[k] == text[k + 1] and word[k + 1] - word[k] <= QUOTE:
            inside[max(min(first[k], word[k + 1]), 0) : word[k + 1] + 1] = True
            k += 2
        else:
            k += 1
    return inside


def in_quotes(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, before: np.ndarray, row: np.ndarray, reports: np.ndarray) -> np.ndarray:
    """Whether words stand in quotation marks or shortly after a word of reporting (``reports``)."""
    place, sums = np.arange(len(row)), np.concatenate([[0], np.cumsum(reports)])
    return quotations(data, offsets, starts) | (sums[place] - sums[np.maximum(place - BEFORE, before[:-1][row])] > 0)


def inputs(sums: np.ndarray, hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Inputs of the regression: weights of exact and misspelt hits, each plain and quoted; plain exact hits; words."""
    out = np.zeros((len(n), Hits.WIDTH))
    out[:, :4] = np.log1p(sums)
    out[:, 4] = hits / np.maximum(n, 1) * 10
    out[:, 5] = hits > 0
    out[:, 6] = hits > 1
    return out


class Hits:
    """Inputs of the regression for each text."""

    WIDTH = 7

    def __init__(self, terms: dict[str, float]):
        self.automaton = Automaton(terms)
        self.known = SpanValues(np.float64, CACHE, self._learn)

    def _learn(self, spans: list[bytes], _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for found in map(terms_of, spans):
            values = [tuple(float(np.float32(v)) for v in self.automaton.read(w)) for w in found]
            out += [sum(v[0] for v in values), sum(v[1] for v in values), float(any(w in REPORTING for w in found)), float(sum(v[0] > 0 for v in values))]
        return np.array(out, np.float64), np.full(len(spans), 4)

    def features(self, texts: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(texts)
        starts, ends, before = words(data, offsets)
        n = np.diff(before)
        row = np.repeat(np.arange(len(n)), n)
        values = self.known.take(data, starts, ends)[0].reshape(-1, 4)
        quoted = in_quotes(data, offsets, starts, before, row, values[:, 2])
        sums = [np.bincount(row, values[:, of] * where, len(n)) for of, where in [(0, ~quoted), (0, quoted), (1, ~quoted), (1, quoted)]]
        return inputs(np.array(sums).T, np.bincount(row, values[:, 3] * ~quoted, len(n)), n)


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression with an intercept (Newton steps)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), ridge * len(x) / 100 * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
    return w


def _answers(out: dict, x: np.ndarray, then: np.ndarray | None) -> dict:
    if then is None:
        return out | {"x": pa.array(list(x), pa.list_(pa.float64()))}
    return out | {"score": pa.array(1 / (1 + np.exp(-np.clip(x @ then[:-1] + then[-1], -30, 30))))}


def _schema(then: np.ndarray | None, more: str) -> str:
    return "doc_id long" + (f", {more} int" if more else "") + (", x array<double>" if then is None else ", score double")


def _hits(docs: DataFrame, terms: dict[str, float], then: np.ndarray | None, more: str = "") -> DataFrame:
    """Inputs (``then`` is None) or scores of all rows."""

    def make():
        hits = Hits(terms)

        def step(batch: pa.RecordBatch) -> dict:
            out = {"doc_id": batch.column(0)} | ({more: batch.column(2)} if more else {})
            return _answers(out, hits.features(batch.column(1)), then)

        return step

    return map_batches(docs.select("doc_id", "text", *([more] if more else [])), make, _schema(then, more))


def _parts(word: Column, twice: Column) -> Column:
    """The parts of the lexicon in which a word is looked for or a term is kept: by its first two letters and, if ``twice``, by its last two.

    An edit behind the first two letters leaves these, one in the first two leaves the last two, so one of both parts is shared by any two words one edit apart.
    """
    ends = F.array(F.concat(F.lit("f:"), F.substring(word, 1, 2)), F.concat(F.lit("l:"), F.substring(word, -2, 2)))
    return F.when(twice, ends).otherwise(F.slice(ends, 1, 1))


def _read_part(terms: pa.Table, asked: pa.Table) -> pa.Table:
    automaton = Automaton(dict(sorted(zip(terms["term"].to_pylist(), terms["weight"].to_pylist(), strict=True))))
    found = [(w, *v) for w in asked["word"].to_pylist() if any(v := automaton.read(w))]
    return pa.table({n: pa.array([f[i] for f in found], kind) for i, (n, kind) in enumerate([("word", pa.string()), ("exact", pa.float64()), ("near", pa.float64())])})


def _found(distinct: DataFrame, terms: DataFrame, most: int | None = None) -> DataFrame:
    """(word, exact, near) of the words that are hits: what ``Automaton.read`` returns, by a trie for each part of the lexicon.

    A part with more than ``most`` terms or ten times as many words is cut further, and all pieces of its terms meet all pieces of its words, so a task
    holds one piece of both.
    """
    most = most or TERMS
    word = F.substring("term", 3, 1_000_000)
    kept = terms.select("term", "weight", F.explode(_parts(word, F.col("term").startswith("w:") & (F.char_length(word) >= FUZZY))).alias("part"))
    asked = distinct.select("word", F.explode(_parts(F.col("word"), F.char_length("word") >= FUZZY - 1)).alias("part"))

    def pieces(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy("part").agg(F.ceil(F.count("*") / size).alias(name))

    cuts = pieces(kept, most, "_t").join(pieces(asked, 10 * most, "_w"), "part")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    kept = kept.join(cuts, "part").select("term", "weight", "part", F.pmod(F.xxhash64("term"), F.col("_t")).alias("_i"), each("_w").alias("_j"))
    asked = asked.join(cuts, "part").select("word", "part", F.pmod(F.xxhash64("word"), F.col("_w")).alias("_j"), each("_t").alias("_i"))
    met = kept.groupBy("part", "_i", "_j").cogroup(asked.groupBy("part", "_i", "_j")).applyInArrow(_read_part, "word string, exact double, near double")
    best = met.groupBy("word").agg(F.max("exact").alias("exact"), F.max("near").alias("near"))
    return best.withColumn("near", F.when(F.col("exact") > 0, 0.0).otherwise(F.col("near")))


def _joined_hits(docs: DataFrame, terms: DataFrame, then: np.ndarray | None, more: str = "") -> DataFrame:
    """The same as ``_hits`` for any number of terms."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            data, offsets = text_bytes(batch.column(1))
            starts, ends, before = words(data, offsets)
            n = np.diff(before)
            row, whole = np.repeat(np.arange(len(n)), n), data.tobytes()
            spans = [terms_of(whole[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            quoted = in_quotes(data, offsets, starts, before, row, np.array([any(w in REPORTING for w in s) for s in spans], float)).astype(int).tolist()
            rows: list[dict] = [{} for _ in n]
            for r, found, q in zip(row.tolist(), spans, quoted, strict=True):
                for word in found:
                    if len(word) >= BEGIN:
                        rows[r].setdefault(word, [0, 0])[q] += 1
            found = [[{"word": w, "times": t[0], "quoted": t[1]} for w, t in r.items()] for r in rows]
            kind = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64()), ("quoted", pa.int64())]))
            out = {"doc_id": batch.column(0), "n": pa.array(n), "words": pa.array(found, kind)}
            return out | ({more: batch.column(2)} if more else {})

        return step

    own = [more] if more else []
    schema = "doc_id long, n long, words array<struct<word: string, times: bigint, quoted: bigint>>" + (f", {more} int" if more else "")
    stored = write_through(map_batches(docs.select("doc_id", "text", *own), make, schema), "words")
    # a row is known by its place: ids may be null or repeated
    stored = stored.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    each = stored.select("_file", "_row", F.explode("words").alias("w")).select("_file", "_row", "w.*")
    values = write_through(_found(each.select("word").distinct(), terms), "hits").select("word", *[F.col(c).cast("float").cast("double").alias(c) for c in ("exact", "near")])
    sums = [F.sum(F.col(v) * F.col(c)).alias(f"s{k}") for k, (v, c) in enumerate([("exact", "times"), ("exact", "quoted"), ("near", "times"), ("near", "quoted")])]
    met = each.join(values, "word").groupBy("_file", "_row").agg(*sums, F.sum(F.when(F.col("exact") > 0, F.col("times"))).alias("hits"))
    full = stored.drop("words").join(met, ["_file", "_row"], "left").fillna(0, ["s0", "s1", "s2", "s3", "hits"])

    def answer():
        def step(batch: pa.RecordBatch) -> dict:
            s0, s1, s2, s3, hits, n = (np.asarray(batch.column(c)) for c in range(1, 7))
            out = {"doc_id": batch.column(0)} | ({more: batch.column(7)} if more else {})
            return _answers(out, inputs(np.array([s0, s1, s2, s3]).T, hits, n), then)

        return step

    return map_batches(full.select("doc_id", "s0", "s1", "s2", "s3", "hits", "n", *own), answer, _schema(then, more))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row."""
    rows = labelled(docs, labels, "toxic")
    terms = lexicon(rows)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = terms.limit(TERMS + 1).collect()
    if not few:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    hits: Callable[..., DataFrame] = _hits if len(few) <= TERMS else _joined_hits
    held = {r["term"]: r["weight"] for r in sorted(few)} if len(few) <= TERMS else terms
    known = hits(sample(rows, SAMPLE), held, None, "label").toArrow()
    x = np.array(known["x"].to_pylist()).reshape(-1, Hits.WIDTH)
    return hits(docs, held, regress(x, np.asarray(known["label"].combine_chunks()).astype(float)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
