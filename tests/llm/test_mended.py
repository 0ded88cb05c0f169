"""Repeated rows, names that clash, draws beyond numpy's limit, and other cases that were found wrong once."""

import sys
import time
from collections import Counter
from math import comb
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import differs  # noqa: E402

from tracefold.llm import labels, op1_minhash, op2_quality_rules, op3_sharding, op8_quality_classifier, op10_exact_dedup  # noqa: E402

NEAR = [" ".join(f"w{i}" if i != k else "other" for i in range(80)) for k in (3, 70)]


def test_a_thousand_repeats_of_near_texts(spark):
    """Repeats are compared once: pairs and texts must not multiply."""
    rows = [(1, NEAR[0])] * 1000 + [(2, NEAR[1])] * 1000 + [(3, "something else entirely")] * 10 + [(None, NEAR[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.time()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in op1_minhash.components(docs).collect()) == {(1, 1, True): 1000, (2, 1, False): 1000, (3, 3, True): 10, (None, 1, False): 1}
    assert time.time() - start < 120
    assert sorted(r.doc_id for r in op1_minhash.keep_rows(docs).collect()) == [1, 3]


def test_several_texts_of_one_id(spark):
    rows = [(1, NEAR[0]), (1, "only here a b c d"), (2, NEAR[1]), (2, NEAR[1] + " end"), (3, "only here a b c d"), (4, "not linked at all")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in op1_minhash.components(docs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_names_may_clash(spark):
    names = [f"__{n}" for n in ("d", "h", "c", "ties", "f", "once", "words", "lines", "hashes", "windows", "score", "sha", "chars", "file", "row", "lane", "key", "start", "node", "size", "prefix", "whole", "open")]
    docs = spark.createDataFrame([(1, NEAR[0] + " the and of"), (2, NEAR[1] + " the and of"), (2, NEAR[1] + " the and of")], "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    known = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    results = [op1_minhash.keep_rows(docs), op2_quality_rules.keep_rows(docs), op3_sharding.shards(docs, 2).drop("law", "shard", "slot", "grown_shard"),
               op8_quality_classifier.keep_rows(docs, known), op10_exact_dedup.keep_rows(docs)]
    for out, n in zip(results, (1, 3, 3, 3, 2), strict=True):
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) == n and all(r[c] == c for r in rows for c in names)


def test_white_space_of_exact_texts(spark):
    rows = [(1, "a b"), (2, "a\x0bb"), (3, "a\x0cb\r"), (4, "a\tb\n"), (5, "a-b"), (6, "a\x1cb"), (7, "a\xa0b"), (8, None), (9, "\x0c\r")] + [(10 + i, "same size") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    got = op10_exact_dedup.exact_groups(docs).drop("chars").toPandas()
    assert differs(got, con.sql(op10_exact_dedup.GROUPS).df()) is None
    assert len({r.keep_id for r in got.itertuples() if r.doc_id <= 4}) == 1
    kept = {r.doc_id for r in op10_exact_dedup.keep_rows(docs).collect()}
    assert kept == {r.doc_id for r in got.itertuples() if r.kept}


def test_any_share_can_be_drawn(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    assert 800 < labels.share(rows, 1000, 20_000).count() < 1200
    # more labels than a whole number of millionths: a few rows, not none of the range
    some = labels.share(rows, 4_000, 10**14)
    assert some.count() == 0 and "false" not in some._jdf.queryExecution().optimizedPlan().toString().lower()
    bound = -(2**63) + 2**64 * 4_000 // 10**14
    assert bound > -(2**63) + 700_000_000


def test_hypergeometric_law():
    draw = np.random.default_rng(5)
    for good, bad, take in ((7, 5, 6), (30, 3, 10), (200, 900, 50)):
        seen = Counter(op3_sharding.hypergeometric(good, bad, take, draw) for _ in range(4000))
        law = {k: comb(good, k) * comb(bad, take - k) / comb(good + bad, take) for k in range(max(0, take - bad), min(good, take) + 1)}
        assert set(seen) <= set(law)
        assert sum((seen[k] - 4000 * p) ** 2 / (4000 * p) for k, p in law.items() if 4000 * p >= 5) < 2.2 * len(law) + 20
    half = [op3_sharding.hypergeometric(10**12, 10**12, 10**12, draw) - 5 * 10**11 for _ in range(300)]
    assert abs(np.std(half) / (10**12 / 8) ** 0.5 - 1) < 0.15 and abs(np.mean(half)) < 5 * (10**12 / 8 / 300) ** 0.5


def test_large_draws_are_exact_at_a_lowered_limit():
    left = np.array([50, 0, 30, 120, 9])
    sums = np.zeros(5)
    for i in range(600):
        got = op3_sharding._large(left, 60, np.random.default_rng(i), limit=40)
        assert got.sum() == 60 and (got <= left).all() and (got >= 0).all()
        sums += got
    assert np.allclose(sums / 600, 60 * left / left.sum(), atol=0.6)


def test_shards_are_reproducible_and_uniform(spark):
    docs = spark.range(0, 4000, 1, 5).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    one = {r.doc_id: (r.shard, r.slot) for r in op3_sharding.shards(docs, 8).collect()}
    assert one == {r.doc_id: (r.shard, r.slot) for r in op3_sharding.shards(docs, 8).collect()}
    # where neighbours go: pairs of shards by chi-square, and no order is kept within a shard
    pairs = Counter((one[i][0], one[i + 1][0]) for i in range(3999))
    assert sum((pairs[a, b] - 3999 / 64) ** 2 / (3999 / 64) for a in range(8) for b in range(8)) < 63 + 4 * (2 * 63) ** 0.5
    kept = sum(one[i][1] < one[j][1] for i in range(0, 4000, 3) for j in [i + 7] if j < 4000 and one[i][0] == one[j][0])
    same = sum(one[i][0] == one[i + 7][0] for i in range(0, 3993, 3))
    assert abs(kept - same / 2) < 3 * same**0.5
    assert one != {r.doc_id: (r.shard, r.slot) for r in op3_sharding.shards(docs, 8, seed=18).collect()}


@pytest.mark.parametrize("n", [0, 1, 3])
def test_small_tables_keep_their_rows(spark, n):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(n)], "doc_id long, text string")
    assert op10_exact_dedup.keep_rows(docs).count() == op1_minhash.keep_rows(docs).count() == n


def test_words_next_to_punctuation():
    import pyarrow as pa

    from tracefold.llm import op5_toxicity as op5

    hits = op5.Hits({"w:moron": 2.0})
    texts = ["you moron,you fool", "moron-like", "you...moron!you", "a\xa0moron here", "«moron»", "m.o.r.o.n", "(mroron)/x", "a 5\" pipe and then " + "filler " * 40 + "you moron", "clean words only", ""]
    x = hits.features(pa.array(texts))
    assert (x[[0, 1, 2, 3, 5, 7], 0] > 0).all() and (x[[0, 1, 2, 3, 5, 7], 1] == 0).all()  # exact and plain
    assert x[4, 1] > 0 and x[4, 0] == 0 and x[6, 2] > 0 and not x[[8, 9], :6].any()
    assert op5.terms_of("Moron,you".encode()) == ["moron", "you"] and op5.terms_of(b"42") == []


@pytest.mark.parametrize("pair", ['""', "“”", "„“", "«»"])
def test_quotes_are_near_each_other(pair):
    import pyarrow as pa

    from tracefold.llm import op5_toxicity as op5

    a, b = pair
    quoted = op5.Hits({"w:moron": 2.0}).features(pa.array([f"a sign {a}big moron{b} there", f"{a}x{b} such a moron {a}y{b}", f"{a}open " + "filler " * 50 + f"moron and {a}z{b}", f"sign:{a}moron{b}"]))
    assert (quoted[:, 0] > 0).tolist() == [False, True, True, False] and (quoted[:, 1] > 0).tolist() == [True, False, False, True]


def _one_edit(a, b):
    return a == b or abs(len(a) - len(b)) <= 1 and any(a[:i] + a[i + 1:] == b or a == b[:i] + b[i + 1:] or (len(a) == len(b) and a[:i] + a[i + 1:] == b[:i] + b[i + 1:]) for i in range(max(len(a), len(b))))


@pytest.mark.parametrize("most", [1, 5, 20_000])
def test_parts_of_the_lexicon_against_plain_edit_distance(spark, most):
    """Tries cut into parts of any size, and the whole one, find what comparing each word with each term finds."""
    from tracefold.llm import op5_toxicity as op5

    draw = np.random.default_rng(11)
    make = lambda n, longest: {"".join(draw.choice(list("abé"), draw.integers(4, longest))) for _ in range(n)}
    terms = {f"w:{w}": float(i % 7 + 1) for i, w in enumerate(sorted(make(60, 9)))} | {f"p:{w}": float(i % 5 + 1) for i, w in enumerate(sorted(make(8, 8)))}
    asked = sorted(make(500, 10) | {t[2:] for t in terms} | {t[2:-1] for t in terms if len(t) > 6} | {"z" + t[3:] for t in terms})
    want = {}
    for w in asked:
        exact = max((v for t, v in terms.items() if (w == t[2:] if t[0] == "w" else w.startswith(t[2:]))), default=0.0)
        near = max((v for t, v in terms.items() if t[0] == "w" and len(t) - 2 >= op5.FUZZY and _one_edit(w, t[2:])), default=0.0)
        if exact or near:
            want[w] = (exact, 0.0 if exact else near)
    assert len(want) > 150
    read = op5.Automaton(terms).read
    assert {w: read(w) for w in asked if any(read(w))} == want
    table = spark.createDataFrame(list(terms.items()), "term string, weight double")
    assert {r.word: (r.exact, r.near) for r in op5._found(spark.createDataFrame([(w,) for w in asked], "word string"), table, most).collect()} == want


def test_the_net_reads_words():
    """Labels that only words tell, as all words are alike in length and letters' kinds."""
    import pyarrow as pa

    draw = np.random.default_rng(2)
    texts, label = [], []
    for i in range(400):
        n = int(draw.integers(20, 300))
        picked = np.where(draw.random(n) < 0.15, "kolma" if i % 2 else "sarpi", draw.choice(["tenku", "bivor", "lusde", "mofan", "gitro", "dolke"], n))
        texts.append(" ".join(picked))
        label.append(i % 2)
    x, sizes = op8_quality_classifier.passages(pa.array(texts))
    assert len(x) == sizes.sum() == sum(-(-len(t.split()) // op8_quality_classifier.PASSAGE) for t in texts)
    split = int(sizes[:300].sum())
    net = op8_quality_classifier.Net(x.shape[1]).fit(x[:split], sizes[:300], np.array(label[:300], float))
    assert np.mean((net.forward(x[split:], sizes[300:])[-1] >= 0.5) == np.array(label[300:])) >= 0.95
    for odd in ([""], [None], ["one"], ["", "one two", None]):
        x, sizes = op8_quality_classifier.passages(pa.array(odd, pa.string()))
        assert len(x) == len(odd) and np.isfinite(x).all() and net.forward(x, sizes)[-1].shape == (len(odd),)
