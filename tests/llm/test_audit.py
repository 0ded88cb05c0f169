"""Clustering, filter audit and decontamination against SQL, brute force and awkward rows, also at lowered limits."""

import itertools
import math
import random
import re
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import differs, duck  # noqa: E402

from tracefold.llm import op11_clustering as op11, op12_filter_audit as op12, op13_decontamination as op13  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module", [op11, op12, op13])
def test_sql(spark, module):
    for name, query in module.QUERIES.items():
        assert differs(query(spark, SMALL).toPandas(), duck(SMALL).sql(module.SQL[name]).df()) is None


def by_sql(module, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    return con.sql(next(iter(module.SQL.values()))).df()


# --- clustering ------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int, distance string")


def odd_vectors():
    draw = random.Random(3)
    rows = [(i, [draw.choice([-0.3, 0.1, 0.2, 0.7]) for _ in range(64)], 1, "x") for i in range(60)]
    rows += [rows[5], rows[5], (5, rows[6][1], 1, "x"), (None, rows[7][1], 1, "x")]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [1.0] * 63 + [float("nan")], [math.inf] + [1.0] * 63, [3e38] + [1.0] * 63]
    return rows, [(100 + i, b, 1, "x") for i, b in enumerate(bad)]


def test_clusters_of_odd_vectors(spark, monkeypatch):
    good, bad = odd_vectors()
    table = vectors(spark, good + bad).repartition(3)
    expect = by_sql(op11, embeddings=table.select("vec_id", "embedding"))
    monkeypatch.setattr(op11, "table", lambda *_: table)
    assert differs(op11.op11_clustering(spark, "").toPandas(), expect) is None and len(expect) == len(good)
    monkeypatch.setattr(op11, "CHUNK", 7)
    assert differs(op11.op11_clustering(spark, "").toPandas(), expect) is None


def test_few_and_no_vectors(spark, monkeypatch):
    good, bad = odd_vectors()
    for rows, n in ((good[:3], 3), (bad, 0), (good[:0], 0)):
        monkeypatch.setattr(op11, "table", lambda *_, rows=rows: vectors(spark, rows))
        out = op11.op11_clustering(spark, "").collect()
        assert len(out) == n and len({r.cluster for r in out}) == n
        assert all(r.distance == r.inertia == 0 for r in out)


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_codes_are_lossless(block):
    numbers = np.random.default_rng(1).integers(-5, 5, (300, 64))
    chunk = op11.Chunk.load(op11.Chunk.of(numbers, block).row(), 64)
    back = np.hstack([d[chunk.codes[:, i]] for i, d in enumerate(chunk.dictionaries)])
    assert (back == numbers).all()
    centroids = numbers[:6]
    cluster, distance = chunk.nearest(centroids)
    whole = ((numbers[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (cluster == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
    assert (chunk.sums(cluster, 6) == [numbers[cluster == k].sum(axis=0) for k in range(6)]).all()


# --- filter audit ----------------------------------------------------------------------------------------------------


def audited(docs, labels):
    """Brute force over (doc_id, text, lang) and (doc_id, quality, toxic)."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    least, out = {}, {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = ({d for d, *v in labels if v[i] == 1 and d is not None} for i in (0, 1))
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = word.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and least[t] < d}
        rows.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine),
                                                   sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def odd_documents():
    draw = random.Random(5)
    long = " ".join(f"word{i % 331}" for i in range(900))
    texts = [None, "", " \n", long, long + "!", long[:200], long[:16], long[:17], long[:-1] + "é", "A b # c", "UPPER lower", " ".join(["same"] * 300), "日本 語"]
    rows = [(draw.randrange(40), draw.choice(texts), draw.choice(["en", "de", "", None])) for _ in range(300)]
    return rows + [(None, long, "en"), (None, None, None), (7, long, "en"), (7, long, "en"), (7, long, "de")]


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("limits", [{}, {"TRIE_BYTES": 1, "CELL_BYTES": 1}, {"TRIE_BYTES": 500, "CELL_BYTES": 2_000}, {"CELL_BYTES": 1, "OUT_ROWS": 3}])
def test_audit_is_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(op12, name, value)
    docs, labels = odd_documents(), [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, 1), (None, 1, 1), (90, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("part", "mask", "n", "cell", "bit", "good")})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = op12.audit(op12.reduced(op12.duplicates(op12.masks(table.repartition(4))), known)).collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in out} == audited(docs, labels)
    assert differs(op12.audit(op12.reduced(op12.duplicates(op12.masks(table)), known)).toPandas(), by_sql(op12, documents=table, labels=known)) is None
    assert op12.audit(op12.reduced(op12.duplicates(op12.masks(table.limit(0))), known)).count() == 0


def test_trie_is_compressed_and_holds_whole_texts():
    trie = op12.Trie(lambda *_: None)
    draw = random.Random(2)
    texts = {bytes(draw.choices(b"ab", k=draw.randrange(12))) for _ in range(300)}
    for t in texts:
        trie.add(t, 1, "", 0, 1)
    assert {t for t, _ in trie.terminals()} == texts
    stack = [trie.root]
    while stack:
        node = stack.pop()
        assert node is trie.root or node.least is not None or len(node.kids) > 1
        assert all(k.label[0] == c for c, k in node.kids.items())
        stack += node.kids.values()


def test_cells_of_a_hot_prefix_get_smaller(spark, monkeypatch):
    """A license in front of a third of all texts doesn't make one large cell."""
    monkeypatch.setattr(op12, "CELL_BYTES", 3_000)
    head = "the same license at the beginning of very many texts " * 4
    docs = spark.createDataFrame([(i, head + f"text {i % 150} and more") for i in range(300)], "doc_id long, text string").withColumns({"part": F.lit(""), "mask": F.lit(0), "n": F.lit(1)})
    found = op12.cells(docs).groupBy("cell").agg(F.count("*").alias("n")).collect()
    assert len(found) == 150 and {r.n for r in found} == {2}


# --- decontamination -------------------------------------------------------------------------------------------------


def hit_words(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: word.findall((t or "").translate(lower))
    wins = {}
    for item, t in items:
        w = split(t)
        n = min(len(w), 10)
        for s in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[s : s + n]), set()).add("" if item is None else str(item))
    out = []
    for d, t in docs:
        w, places, found = split(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    places.update(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        out.append((d, len(w), len(places), sorted(found)))
    return sorted(out, key=repr)


def planted():
    draw = random.Random(9)
    pool = [f"w{i}" for i in range(30)]
    passage = lambda n: " ".join(draw.choices(pool, k=n))
    items = [(i, passage(draw.choice([12, 20, 40]))) for i in range(12)] + [(20, passage(3)), (21, "ab"), (22, passage(9)), (23, passage(10)), (None, passage(15)), (3, passage(11)), (24, ""), (25, None), (26, "a " * 30)]
    items += [(27, items[0][1]), (28, items[0][1] + " more words at the end")]
    docs = []
    for k in range(80):
        text = passage(draw.randrange(60))
        for _ in range(draw.randrange(3)):
            w = (draw.choice(items)[1] or "").split()
            a = draw.randrange(len(w) + 1)
            text += " | " + " ".join(w[a : a + draw.randrange(5, 14)]).title() + ", " + passage(draw.randrange(6))
        docs.append((draw.choice([k, k, None, 5]), text))
    return docs + [(1, None), (2, ""), (3, "a a a " * 20), (4, " ".join(t or "" for _, t in items)), (4, " ".join(t or "" for _, t in items)), (6, "é日 \x00 A-B_c" * 5)], items


@pytest.mark.parametrize("limits", [{}, {"LEAST_SLOTS": 1, "SLOTS": 4}, {"BROADCAST_BYTES": 0}])
def test_decontamination_is_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(op13, name, value)
    docs, items = planted()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_row", "n_words", "window", "start", "item_ids", "x", "w")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1)).withColumn("n", F.lit(2))
    got = op13.contamination(table.repartition(3), bench)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got.collect()), key=repr) == hit_words(docs, items)
    for no in (bench.limit(0), bench.where("item_id IN (24, 25)")):
        assert {(r.n_hit, len(r.item_ids)) for r in op13.contamination(table, no).collect()} == {(0, 0)}
    assert op13.contamination(table.limit(0), bench).count() == 0


def test_every_shared_span_shares_a_fingerprint(spark):
    """The winnowing guarantee, on texts with many repeats."""
    draw = random.Random(4)
    for letters in ("ab", "abcdef", "a"):
        span = draw.choices(letters, k=10)
        rows = [(" ".join(draw.choices(letters, k=draw.randrange(30)) + span + draw.choices(letters, k=draw.randrange(30))),) for _ in range(30)]
        h = op13.hashed(op13.words_of("text"))
        places = spark.createDataFrame(rows, "text string").select(op13.bound(h, lambda x: F.transform(op13.kept_places(x, lambda g: F.lit(True)), lambda p: F.get(op13.grams(x, 5), p))).alias("g")).collect()
        assert set.intersection(*[set(r.g) for r in places])
