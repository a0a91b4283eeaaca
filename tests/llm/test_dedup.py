"""The Jaccard join and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmill.llm import jaccard_join, packed, substring_dedup, textkit
from tests.llm.data import DOCS, documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeÀé") for _ in range(rng.randrange(1, 4)))
    base = [[word() for _ in range(rng.randrange(1, 120))] for _ in range(30)]
    made = []
    passage = [word() for _ in range(20)]
    for b in base:
        for _ in range(rng.randrange(1, 9)):
            copy = list(b)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy[len(copy) // 2 : len(copy) // 2] = passage
            made.append(rng.choice([" ", "\n", "\t ", "  "]).join(copy))
    chain = [word() for _ in range(100)]
    for i in range(40):  # each links to its neighbours only
        made.append(" ".join(chain[: 100 - i] + [f"x{j}" for j in range(i)]))
    rng.shuffle(made)
    return [*made, "", None, " \n", "a", "A", "b c", made[0], made[1].upper(), "long " * 5000]


def shingles(text, k):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    comp = list(range(len(texts)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both and 100 * both >= percent * len(s | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 60)])
def test_components_equal_brute_force(spark, texts, k, percent):
    sizes, comp = components(texts, k, percent)
    got = sorted(rows(jaccard_join.classes(documents(spark, texts), k, percent)), key=lambda r: r["doc_id"])
    assert [r["n_shingles"] for r in got] == sizes
    assert [r["component_id"] for r in got] == comp


def test_large_regions_are_divided_exactly(spark, texts, monkeypatch):
    """Regions of more than four nodes go through pivots, cells with windows, and blocks."""
    monkeypatch.setattr(jaccard_join, "REGION", 4)
    monkeypatch.setattr(jaccard_join, "PIVOT_ROUNDS", 2)
    _, comp = components(texts, 4, 85)
    got = sorted(rows(jaccard_join.classes(documents(spark, texts), 4, 85)), key=lambda r: r["doc_id"])
    assert [r["component_id"] for r in got] == comp


def thue_morse(n):
    """A word and its complement that polynomial hashes cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_one_polynomial_hash_are_not_one_word(spark):
    one, other = thue_morse(1024)
    rest = [f"w{i}" for i in range(12)]
    texts = [" ".join([one, *rest]), " ".join([other, *rest])]
    got = rows(jaccard_join.classes(documents(spark, texts), 4, 85))
    assert sorted(r["component_id"] for r in got) == [0, 1]
    assert [r["n_removed"] for r in rows(substring_dedup.dedup(documents(spark, texts)))] == [0, 0]


@pytest.mark.parametrize("most", [0, None])
def test_cells_lose_no_link_and_a_forest_spans(texts, most, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 5)
    sets = {s.tobytes(): s for s in jaccard_join.shingle_sets(texts, 4) if len(s)}.values()
    nodes = [jaccard_join._Node(i, len(s), jaccard_join.sketch_of(s), i) for i, s in enumerate(sets)]
    plain = [set(s.tolist()) for s in sets]
    links = {(i, j) for i, a in enumerate(plain) for j, b in enumerate(plain) if i < j and 100 * len(a & b) >= 85 * len(a | b)}
    found = list(jaccard_join._candidates(nodes, 85, most))
    assert len(links) > 100
    if most is None:
        assert links <= set(found)
    else:
        comp = list(range(len(plain)))
        for a, b in found:  # no edge of the forest closes a circle
            assert comp[a] != comp[b]
            comp = [comp[a] if c == comp[b] else c for c in comp]
        assert all(comp[a] == comp[b] for a, b in links)


def test_sketches_bound_what_is_shared():
    rng = random.Random(1)
    for n, m, both in ((10, 12, 8), (500, 520, 500), (3000, 90, 90), (64, 64, 0)):
        grams = [rng.getrandbits(64) for _ in range(n + m - both)]
        make = lambda g, i: jaccard_join._Node(i, len(g), jaccard_join.sketch_of(np.array(sorted(g), dtype=np.uint64)), i)
        a, b = make(grams[:n], 0), make(grams[n - both :], 1)
        assert both <= jaccard_join._shared_at_most(a, b) <= min(n, m)
    assert jaccard_join.word_set("A b  C d\te", 4) == {(b"a", b"b", b"c", b"d"), (b"b", b"c", b"d", b"e")}


def test_representatives_keep_columns_and_one_of_repeated_rows(spark, texts):
    docs = documents(spark, texts[:60]).withColumn("th", F.lit("mine")).withColumn("node", F.lit(1))
    _, comp = components(texts[:60], 5, 80)
    kept = jaccard_join.representatives(docs.unionByName(docs))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in rows(kept)) == sorted(set(comp))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in rows(jaccard_join.components(edges))}
    assert got == {**{i: 0 for i in range(71)}, 100: 100, 101: 100}


def test_null_doc_id_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, "other words that stand alone here")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows(jaccard_join.classes(docs)))
    assert got == [("5", "5"), ("None", "5"), ("None", "None")]
    assert jaccard_join.classes(spark.createDataFrame([], DOCS)).count() == 0


def cut(texts, ids, width):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in zip(ids, words):
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in zip(ids, words):
        gone = set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone.update(range(j, j + width))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("width", [13, 5])
def test_removed_words_equal_brute_force(spark, texts, width):
    want = cut(texts, range(len(texts)), width)
    docs = documents(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("key", F.lit(0))
    got = sorted(rows(substring_dedup.dedup(docs, width)), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_words"], r["n_removed"]) for r in got] == [w[:3] for w in want]
    for r, w, t in zip(got, want, texts):
        assert r["kept_sha256"] == hashlib.sha256(w[3].encode()).hexdigest()
        assert r["kept_text"] == (w[3] if r["n_removed"] else t) and r["key"] == 0 and r["lang"] == "en"


def test_repeated_rows_and_one_id_with_two_texts(spark):
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i}" for i in range(10, 40))
    docs = spark.createDataFrame([(3, a), (3, a), (3, b), (7, b), (None, a), (1, "x")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in rows(substring_dedup.dedup(docs)))
    assert got == [("1", 0), ("3", 0), ("3", 0), ("3", 0), ("7", 30), ("None", 30)]
    assert substring_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_small_slices_settle_the_same(spark, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", 2000)
    docs = documents(spark, texts).repartition(3)
    before = sorted((r["doc_id"], r["kept_sha256"]) for r in rows(substring_dedup.dedup(docs)))
    w = cut(texts, range(len(texts)), 13)
    assert before == sorted((x[0], hashlib.sha256(x[3].encode()).hexdigest()) for x in w)


def test_hashes_and_packing():
    a, b = textkit.Words(["x yy zzz", "yy", None, "é yy\x0bq"]), textkit.Words(["yy", "zzz é"])
    assert a.counts().tolist() == [3, 1, 0, 3]
    assert a.hash[1] == a.hash[3] == a.hash[5] == b.hash[0] and a.hash[2] == b.hash[1] and a.hash[4] == b.hash[2]
    assert len(set(a.hash.tolist())) == 5
    parts = textkit.Words(["it's a-b, (c)1."], parts=True)
    data = parts.buf.tobytes()
    assert [data[s:e].decode() for s, e in zip(parts.start, parts.end)] == ["it's", "a", "-", "b", ",", "(", "c", ")", "1", "."]
    v = np.array([5, 9, 9, 2**63, 2**64 - 1], dtype=np.uint64)
    assert (packed.unpack(packed.pack(v)) == v).all() and (packed.unpack(packed.pack(v, True), True) == v).all()
    assert len(packed.unpack(packed.pack(v[:0], True), True)) == 0
