"""The ten operators against brute force, exact round trips, SQL or held-out accuracy, and on awkward rows."""

import hashlib
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from brute import near_components  # noqa: E402
from compare import differs, duck  # noqa: E402

from tracefold.llm import (  # noqa: E402
    op1_minhash, op2_quality_rules, op3_sharding, op4_sentencepiece, op5_toxicity, op6_packing, op7_token_counts, op8_quality_classifier, op9_chat,
    op10_exact_dedup,
)
from tracefold.llm.labels import labelled  # noqa: E402

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 997} and" for i in range(6000))
ODD = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today " * 3), (2, "the quick brown fox jumps over the lazy dog near the river bank today " * 3), (3, None), (4, ""), (5, " \n\t "),
    (6, LONG), (6, LONG), (None, "no id at all"), (None, None), (7, "The  Quick\tbrown <s> ▁ é日😀"), (8, "x" * 3000), (9, "a b c"), (10, "abc"), (11, "a\x1cb c [INST] \\ </s>"),
]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    return docs.select("doc_id", "text", *[F.lit(7).alias(c) for c in ("kept", "n_words", "score", "shard", "size", "length", "label", "node", "ids", "text_sha256")])


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_near_dedup_is_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    base = [f"w{i}" for i in range(60)]
    for k in range(40):  # a group of near copies, some of which are linked through others only
        words = list(base)
        for j in range(k % 7):
            words[(k * 11 + j * 9) % 60] = f"edit{k}_{j}"
        docs.append((10_000 + k, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op1_minhash.components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == near_components(docs)


def test_near_dedup_odd_rows(odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op1_minhash.components(odd).collect()}
    assert {(2, 13, 1, False), (1, 13, 1, True), (3, 0, 3, True), (4, 0, 4, True), (9, 1, 9, True), (None, 0, None, True), (None, 1, None, True)} <= got | {(1, 13, 1, True), (2, 13, 1, False)}
    assert {d for d, _, c, _ in got if c == 1} == {1, 2}
    kept = op1_minhash.keep_rows(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 1 and kept.where("doc_id IS NULL").count() == 2
    assert op1_minhash.components(none).count() == 0


def test_likelihood_finds_similarity():
    draw = np.random.default_rng(1)
    pool = draw.integers(0, 2**63, 600, dtype=np.uint64)
    a, b = pool[:550], pool[50:]
    k = op1_minhash.registers(np.repeat([0, 1], 550), np.concatenate([a, b]), 2)
    both = op1_minhash.registers(np.zeros(600, int), pool, 1)
    assert (np.maximum(k[0], k[1]) == both[0]).all()  # mergeable
    j = op1_minhash.likeliest(np.array([550]), np.array([550]), (k[:1] > k[1:]).sum(axis=1), (k[:1] < k[1:]).sum(axis=1))
    assert abs(j[0] - 500 / 600) < 0.08


@pytest.mark.parametrize("module", [op2_quality_rules, op9_chat, op10_exact_dedup])
def test_sql(spark, module):
    for name, query in module.QUERIES.items():
        assert differs(query(spark, SMALL).toPandas(), duck(SMALL).sql(module.SQL[name]).df()) is None


def test_quality_rules_odd_rows(odd, none):
    rows = op2_quality_rules.quality(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[3].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[1].n_repeat_words == 42 and by[1].base_failed  # all windows come three times
    assert op2_quality_rules.keep_rows(odd).columns == odd.columns and op2_quality_rules.quality(none).count() == 0


def test_sharding_is_exact(spark, odd, none):
    out = op3_sharding.shards(odd.repartition(3), 4).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == len(ODD) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    assert op3_sharding.shards(none).count() == 0
    sizes, targets = np.array([5, 0, 9, 2]), np.array([4, 4, 4, 4])
    matrix = np.array([op3_sharding.matrix_row(sizes, targets, i, 1) for i in range(4)])
    assert (matrix.sum(axis=1) == sizes).all() and (matrix.sum(axis=0) == targets).all()


def test_sampled_segmentations_are_lossless_and_follow_weights(spark, odd, none):
    out = op4_sentencepiece.decode(op4_sentencepiece.encode(odd)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in out) == sorted((d or -1, t or "") for d, t in ODD)
    again = {r.doc_id: r.ids for r in op4_sentencepiece.encode(odd.repartition(5)).collect()}
    assert all(again[r.doc_id] == r.ids for r in out if r.doc_id)
    both = op4_sentencepiece.round_trip(odd).collect()
    assert all(r.lossless for r in both)
    assert sorted((r.doc_id or -1, r.decoded_crc32, r.ids) for r in both) == sorted((r.doc_id or -1, r.text_crc32, r.ids) for r in out)
    assert op4_sentencepiece.encode(none).count() == op4_sentencepiece.round_trip(none).count() == 0
    pieces = op4_sentencepiece.Pieces()
    sampler = op4_sentencepiece.Sampler(pieces, alpha=0.3)
    n = 20_000
    ids, place = sampler.sample(pa.array(["then"] * n), pa.array(range(n)))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(place[:-1], place[1:], strict=True))
    weight = {}

    def paths(rest, path, w):
        if not rest:
            weight[tuple(path)] = w
        for k in range(1, len(rest) + 1):
            if rest[:k] in pieces.plain:
                i = pieces.plain[rest[:k]]
                paths(rest[k:], [*path, i], w * float(np.exp(sampler.weight[i])))

    paths("▁then", [], 1.0)
    total = sum(weight.values())
    assert set(seen) <= set(weight) and all(abs(seen[p] / n - w / total) < 0.02 for p, w in weight.items())


def test_token_counts_of_all_prefixes():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=op7_token_counts.model_path(None))
    draw, counts = np.random.default_rng(2), op7_token_counts.PieceCounts()
    texts = ["".join(draw.choice(list("ab the e  \n\t▁é€日<s></s>0Ñ́😀"), draw.integers(0, 30))) for _ in range(400)] + [t or "" for _, t in ODD if t != LONG]
    values, place = counts.deltas(pa.array(texts))
    for text, a, b in zip(texts, place[:-1], place[1:], strict=True):
        sums = np.cumsum(values[a:b], dtype=np.int64).tolist()
        if len(text) < 100:
            assert sums == [len(model.encode(text[: i + 1])) for i in range(len(text))]
        assert (sums[-1] if sums else 0) == len(model.encode(text))
    whole = values[place[0] : place[1]].tobytes()
    fits = op7_token_counts.longest_within(whole, 5)
    assert op7_token_counts.tokens_at(whole, fits) <= 5


def test_token_counts_odd_rows(odd, none):
    rows = op7_token_counts.token_prefixes(odd).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    assert op7_token_counts.token_prefixes(none).count() == 0


def test_packing(spark, odd, none):
    tokenizer = op6_packing.WordIds().tokenizer
    out = op6_packing.pack(odd).collect()
    used: dict = {}
    for r in out:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert sorted(used) == list(range(len(used)))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= op6_packing.ROOM
    for doc, text in ODD:
        if doc and doc != 6:
            ids = np.concatenate([np.frombuffer(r.ids, np.uint32) for r in sorted((r for r in out if r.doc_id == doc), key=lambda r: r.start)])
            assert ids.tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    whole = {r.sequence_id: r for r in op6_packing.sequences(spark.createDataFrame(out)).collect()}
    assert all(len(whole[s].ids) == 4 * sum(n for _, n in parts) for s, parts in used.items())
    assert op6_packing.pack(none).count() == 0


def test_patterns_use_each_length_once():
    draw = np.random.default_rng(4)
    for _ in range(50):
        histogram = dict(Counter(draw.integers(1, 65, draw.integers(1, 300)).tolist()))
        back: Counter = Counter()
        for count, pattern in op6_packing.pack_lengths(histogram, 64):
            assert sum(a * b for a, b in pattern) <= 64
            for size, times in pattern:
                back[size] += count * times
        assert back == histogram


@pytest.mark.parametrize("query,label,limit", [(op5_toxicity.op5_toxicity, "toxic", 0.9), (op8_quality_classifier.op8_quality_classifier, "quality", 0.95)])
def test_held_out_accuracy(spark, query, label, limit):
    sf = "/root/testdata/sf0.01"
    rows = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= limit
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifiers_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 1), (9, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for docs, n in ((odd, len(ODD)), (none, 0)):
        assert op5_toxicity.toxicity(docs, labels).count() == n
        assert op8_quality_classifier.score(docs, op8_quality_classifier.train(docs, labels)).count() == n
    assert op8_quality_classifier.keep_rows(odd, labels.limit(0)).columns == odd.columns


def test_automaton_finds_one_edit():
    read = op5_toxicity.Automaton({"w:moron": 2.0, "w:scum": 1.0, "p:lost": 3.0}).read
    assert read("moron") == (2.0, 0.0) and read("scum") == (1.0, 0.0) and read("lostling") == (3.0, 0.0)
    for near in ("mroron", "moon", "morom", "oron", "morons", "xmoron", "mor0n"):
        assert read(near) == (0.0, 2.0), near
    for far in ("morr", "scam", "los", "marun", "", "moronic"):
        assert read(far) == (0.0, 0.0), far


def test_quoted_hits_are_apart():
    hits = op5_toxicity.Hits({"w:moron": 2.0})
    plain, quoted, reported = hits.features(pa.array(["you are a moron", 'a sign "big moron" there', "they said such a moron left"]))
    assert plain[0] > 0 and plain[1] == 0 and quoted[0] == 0 and quoted[1] > 0 and reported[0] == 0 and reported[1] > 0


def test_chat_odd_rows(spark):
    rows = [(1, 1, "assistant", "b\\[SAY]"), (1, 0, "us</s>er", None), (None, None, None, "x"), (2, 0, "assistant", LONG), (2, 0, "assistant", LONG)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in op9_chat.digests(op9_chat.format_turns(talk)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("us</s>er\n\nassistant\nb\\[SAY]\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"b\\[SAY]").hexdigest() and got[2].n_turns == 2 and got[None].loss_chars == 0
    assert op9_chat.digests(op9_chat.format_turns(talk.limit(0))).count() == 0


def test_exact_dedup_odd_rows(odd, none):
    for digests in (True, False):
        rows = op10_exact_dedup.exact_groups(odd, digests).collect()
        assert len(rows) == len(ODD)
        empty = [r for r in rows if r.doc_id in (3, 4, 5)]
        assert {r.keep_id for r in empty} == {5} and {r.group_size for r in empty} == {4}
    kept = op10_exact_dedup.keep_rows(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 5, 6, 7, 8, 9, 11]
    assert op10_exact_dedup.exact_groups(none).count() == 0


def test_pipeline_is_brute_force(spark):
    """The near-dedup and packing stages against direct versions on what the stages before them kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "near_dedup":
            assert kept == {c for _, c in near_components(list(before.items()), 5).values()}
        if name == "exact_dedup":
            bare = Counter("".join((t or "").split(" ")).replace("\n", "") for t in before.values())
            assert len(kept) == len(bare)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.collect()} == kept
    assert labelled(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), "quality").count() <= len(kept)


def _counted(spark, toxic, other, clean=6000):
    """Rows of one word each: ``toxic`` and ``other`` {word: documents}; and ``clean`` more documents without any of them."""
    rows = [(w, 1) for w, n in toxic.items() for _ in range(n)] + [(w, 0) for w, n in other.items() for _ in range(n)] + [("plain", 0)] * clean
    return spark.createDataFrame(rows, "text string, label int")


def test_lexicon_keeps_the_tail(spark):
    """A term that few of very many toxic rows hold has its lift looked at like any other."""
    terms = {r.term for r in op5_toxicity.lexicon(_counted(spark, {"common": 1000, "rareterm": 6, "often": 6, "thin": 4}, {"often": 200})).collect()}
    assert "w:rareterm" in terms and "w:common" in terms
    assert not {"w:often", "w:thin"} & terms


def test_lexicon_is_the_same_in_any_order(spark):
    rows = _counted(spark, {"idiotic": 20, "idiot": 90, "loserly": 30, "loserdom": 30, "loserish": 4}, {})
    found = [{r.term: r.weight for r in op5_toxicity.lexicon(rows.repartition(n)).collect()} for n in (1, 7)]
    assert found[0] == found[1]
    # "idio" is "idiot" and goes, with no word lost; "lose" is several words, stays, and words under it are in the fuzzy trie
    assert set(found[0]) == {"w:idiotic", "w:idiot", "p:lose", "w:loserly", "w:loserdom"}
    read = op5_toxicity.Automaton(found[0]).read
    assert read("idiotic")[0] > 0 and read("idotic")[1] > 0 and read("loserish")[0] > 0 and read("lsoerdom") == (0.0, 0.0) and read("loxerdom")[1] > 0


def test_large_lexicon_gives_equal_scores(spark, odd, monkeypatch):
    """Joined to the words of the texts instead of held as a trie."""
    terms = {"w:moron": 2.0, "w:scum": 1.0, "w:scumbag": 1.5, "p:lost": 3.0, "w:lostling": 3.5, "w:quick": 2.5}
    asked = ["moron", "mroron", "moon", "morons", "mor0n", "morr", "scum", "scam", "scu", "lost", "lostling", "lostlinge", "los", "lxstling", "scumbg", "marun", "quik"]
    read = op5_toxicity.Automaton(terms).read
    table = spark.createDataFrame(list(terms.items()), "term string, weight double")
    got = {r.word: (r.exact, r.near) for r in op5_toxicity._found(spark.createDataFrame([(w,) for w in asked], "word string"), table).collect()}
    assert got == {w: read(w) for w in asked if read(w) != (0.0, 0.0)}
    quoted = spark.createDataFrame([(20, 'you moron "quik scum" they said such a lostling moron'), (20, "moon")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(quoted)
    then = np.arange(1.0, 9.0) / 8
    key = lambda rows: sorted(((r.doc_id or -1), round(r.score, 9)) for r in rows.collect())
    assert key(op5_toxicity._hits(docs, terms, then)) == key(op5_toxicity._joined_hits(docs, table, then))
    sf = "/root/testdata/sf0.01"
    tables = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")]
    held = key(op5_toxicity.toxicity(*tables))
    monkeypatch.setattr(op5_toxicity, "TERMS", 1)
    assert key(op5_toxicity.toxicity(*tables)) == held


def test_sharding_query_moves_documents(spark, monkeypatch):
    """The digests of the query are those of rows that were dealt out with all their columns."""
    seen = []
    shards = op3_sharding.shards
    monkeypatch.setattr(op3_sharding, "shards", lambda docs: seen.append(docs.columns) or shards(docs))
    got = op3_sharding.op3_sharding(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert seen == [docs.columns]
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())


def test_sharding_lanes_are_cut_by_bytes(spark, odd, monkeypatch):
    lanes = []
    row = op3_sharding.equal_parts
    monkeypatch.setattr(op3_sharding, "equal_parts", lambda rows, parts: lanes.append(parts) or row(rows, parts))
    monkeypatch.setattr(op3_sharding, "LANE_BYTES", 20_000)
    out = op3_sharding.shards(odd.repartition(2), 2).collect()
    assert max(lanes[1:]) > 1
    for s in (0, 1):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_shingle_size_decides_what_is_near(spark):
    """200 different words, five of them replaced: 0.816 on four words, 0.774 on five."""
    base = [f"w{i}" for i in range(200)]
    other = [f"new{i}" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(base)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, "a b c d"), (4, "a b c d")], "doc_id long, text string")
    assert {r.doc_id for r in op1_minhash.keep_rows(docs).collect()} == {1, 3}
    assert {r.doc_id for r in op1_minhash.keep_rows(docs, 5).collect()} == {1, 2, 3}


def test_near_dedup_of_five_is_brute_force(spark):
    """With groups of which some members are linked through others only, so every step takes the size."""
    from brute import shingle_set

    docs, base = [], [f"w{i}" for i in range(60)]
    for k in range(40):
        words = list(base)
        for j in range(k % 5):
            words[(k * 11 + j * 9) % 60] = f"edit{k}_{j}"
        docs.append((k, " ".join(words)))
    sets = {d: shingle_set(t, 5) for d, t in docs}
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op1_minhash.components(spark.createDataFrame(docs, "doc_id long, text string"), 5).collect()}
    assert got == {d: (len(s), root[d]) for d, s in sets.items()} and len(set(root.values())) > 1


def test_packing_query_packs_the_ids(spark, monkeypatch):
    """The digests of the query are those of ids that were placed."""
    pieces = op6_packing.pieces
    monkeypatch.setattr(op6_packing, "pieces", lambda *a: pieces(*a).withColumn("ids_crc32", F.lit(0).cast("long")))
    out = {(r.doc_id, r.start): r.ids_crc32 for r in op6_packing.op6_packing(spark, SMALL).collect()}
    monkeypatch.undo()
    held = op6_packing.pack(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    assert out == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in held} and any(out.values())
