"""Vector search, similarity joins and TF-IDF against numpy and plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from inkmill.functions import vectors as V
from inkmill.operators import embed, vector


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 8))
    x[7], x[8] = 0, x[9]
    return x, spark.createDataFrame([(i, i % 4, [float(v) for v in row]) for i, row in enumerate(x)], "id long, book int, vector array<double>")


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def test_top_k(table):
    x, df = table
    s = unit(x) @ unit(x[3:4])[0]
    want = sorted(range(len(x)), key=lambda i: (-round(s[i], 12), i))[:6]
    assert [r["id"] for r in vector.top_k(df, list(x[3]), 6).collect()] == want
    assert vector.top_k(df, list(x[3]), 1000).count() == len(x)


def test_batch_in_query_blocks(table):
    x, df = table
    found = vector.top_k_batch(df, df.where("id % 10 = 0").selectExpr("id as query_id", "vector"), 3, block=4).collect()
    s = unit(x) @ unit(x).T
    for q in range(0, 120, 10):
        want = sorted((i for i in range(120) if i != q), key=lambda i: (-round(s[q, i], 12), i))[:3]
        assert [r["id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_similar_pairs_in_blocks(table):
    x, df = table
    s = unit(x) @ unit(x).T
    want = {(i, j) for i in range(120) for j in range(120) if i % 4 < j % 4 and s[i, j] >= 0.4}
    got = vector.similar_pairs(df, 0.4, block=25).collect()
    assert {(r["id1"], r["id2"]) for r in got} == want and len(got) == len(want)


def sparse_table(spark, n=150, dims=300, seed=8):
    """Few places a row, some of them in most rows, groups of near copies."""
    rng = np.random.default_rng(seed)
    x = np.zeros((n, dims))
    for i in range(n):
        x[i, np.unique(np.minimum(rng.zipf(1.3, size=12) - 1, dims - 1))] = rng.random()
        x[i, rng.integers(0, dims, size=3)] = 1 + rng.random()
    for i in range(0, 60, 3):
        x[i + 1] = x[i] * (1 + 0.2 * rng.random(dims))
    x[5], x[6] = 0, -x[7]
    return x, spark.createDataFrame([(f"i{i:03d}", None if i == 9 else f"b{i % 3}", [float(v) for v in row]) for i, row in enumerate(x)], "id string, book string, vector array<double>")


def test_similar_pairs_through_lists(spark):
    x, df = sparse_table(spark)
    s = unit(x) @ unit(x).T
    book = [None if i == 9 else i % 3 for i in range(len(x))]
    for threshold in (0.3, 0.7, 0.95):
        want = {(f"i{i:03d}", f"i{j:03d}"): s[i, j] for i in range(len(x)) for j in range(len(x)) if None not in (book[i], book[j]) and book[i] < book[j] and s[i, j] >= threshold}
        for block in (16, 2048):  # lists in pieces, and whole
            got = vector.similar_pairs(df, threshold, block=block).collect()
            assert len(got) == len(want) and {(r["id1"], r["id2"]): r["similarity"] for r in got} == pytest.approx(want)
            assert all(r["book1"] < r["book2"] for r in got)
    assert len(want) > 5
    assert vector.similar_pairs(df.limit(0), 0.7).collect() == [] == vector.similar_pairs(df.where("id = 'i005'"), 0.7).collect()
    with pytest.raises(ValueError):
        vector.similar_pairs(df, 0.0)


def test_only_needed_places_are_indexed(spark):
    """The lists hold fewer entries than the vectors, and no pair is multiplied in a block join."""
    _, df = sparse_table(spark)
    plan = vector.similar_pairs(df, 0.7)._jdf.queryExecution().toString()
    assert "led" in plan and "FlatMapGroupsInArrow" in plan and plan.count("normalise") == 0


def test_words_beyond_the_shared_bound(spark):
    """More often words than may be looked up in the text: pairs are found by joins, with the same result."""
    texts = [f"a{i} b{i} a{i} b{i} c{i % 3}x d{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    key = lambda rows: sorted((r["term"], r["tf"], r["df"], round(r["idf"], 9)) for r in rows.collect())
    assert key(embed.tfidf_fit(df, 20, share_words=5)) == key(embed.tfidf_fit(df, 20))
    assert key(embed.tfidf_fit(df, 500, share_words=5)) == key(embed.tfidf_fit(df, 500))
    assert embed.tfidf_fit(df.limit(0), 20).collect() == []


def test_cosine_and_norm(spark):
    q = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in q.select(V.cosine("a", "b")).collect()] == [pytest.approx(0.96), 0.0]
    assert [r[0] for r in q.select(V.normalise("a")).collect()] == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]


def test_tfidf(spark):
    texts = ["The cat sat. the CAT ran", "a dog ran", "é über über café", "x", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    grams = []
    for t in texts:
        u = re.findall(r"\w\w+", t.lower())
        grams.append(Counter(u + [f"{a} {b}" for a, b in zip(u, u[1:])]))
    tf = sum(grams, Counter())
    vocabulary = sorted(tf, key=lambda t: (-tf[t], t))[:10]
    idf = {t: math.log((1 + len(texts)) / (1 + sum(t in g for g in grams))) + 1 for t in vocabulary}
    fitted = embed.tfidf_fit(df, 10)
    assert {r["term"]: r["idf"] for r in fitted.collect()} == pytest.approx(idf)
    got = {(r["id"], r["term"]): r["weight"] for r in embed.tfidf_transform(df, fitted).collect()}
    for i, g in enumerate(grams):
        w = {t: (1 + math.log(g[t])) * idf[t] for t in vocabulary if g[t]}
        n = math.sqrt(sum(v * v for v in w.values()))
        assert {t: got[i, t] for t in w} == pytest.approx({t: v / n for t, v in w.items()})
    dense = embed.dense(embed.tfidf_sparse(df, fitted), 12).where("id <> 3 and id <> 4").collect()
    assert all(len(r["vector"]) == 12 and sum(v * v for v in r["vector"]) == pytest.approx(1) for r in dense)
    cache = spark.createDataFrame([("tfidf", "9dd4e461268c8034f5c8564e155c67a6"), ("other", "d41d8cd98f00b204e9800998ecf8427e")], "model string, key string")
    assert sorted(r["id"] for r in embed.cache_misses(df, cache).collect()) == [0, 1, 2, 4]
