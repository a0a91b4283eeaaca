"""Ranked lexical search: against a plain scorer, the dynamic program against all cuts, skipping, odd tables."""

import itertools
import math
import re

import numpy as np

from inkmill.llm import lexical_search as ls
from tests.llm.data import documents, rows

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=20):
    """Every score of every text by the definition."""
    words = {i: TERM.findall((t or "").translate(LOWER)) for i, t in docs}
    words = {i: w for i, w in words.items() if w}
    n_docs, n_terms = len(words), sum(map(len, words.values()))
    out = []
    for item, text in items:
        score = dict.fromkeys(words, 0)
        for term in TERM.findall((text or "").translate(LOWER)):
            df = sum(term in w for w in words.values())
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            for i, w in words.items():
                tf = w.count(term)
                score[i] += weight * ((10**9 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n_docs) // n_terms)))
        best = sorted((i for i in score if score[i] > 0), key=lambda i: (-score[i], i))[:k]
        out += [(item, r + 1, i, score[i]) for r, i in enumerate(best)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


def test_equals_plain_scores(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}é" if i % 3 else f"W{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(vocabulary, size=rng.integers(1, 80), p=weights / weights.sum())) for _ in range(400)]
    texts += texts[:40] + [None, "", "?! -", "w1é" * 5000, " ".join(["W0"] * 3000)]
    items = [(1, texts[3]), (2, "W0 W0 w59é"), (3, None), (4, "--"), (5, "unknown words"), (2, "w1é/W3"), (6, texts[441] or "W0")]
    docs = documents(spark, texts)
    table = spark.createDataFrame(items, "item_id long, text string")
    want = plain(list(enumerate(texts)), items, 7)
    for shard in (16, 10_000):  # many shards a task, and one
        assert found(ls.search(docs, table, 7, shard_docs=shard)) == want
    assert found(ls.search(docs, table, 7, item_block=2)) == want


def test_blocks_are_the_cheapest_cut():
    rng = np.random.default_rng(5)
    lists = [rng.integers(1, 100, size=n) for n in (0, 5, 8, 61, 70, 0, 33)]
    impact, first = np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    begin = ls.cut(impact, first, price=2.0)

    def cost(x, cuts):
        price = 2.0 * np.abs(x - x.mean()).mean()
        return sum(price + (x[a:b].max() - x[a:b]).sum() for a, b in zip(cuts, [*cuts[1:], len(x)]))

    for i, x in enumerate(lists):
        own = [int(b - first[i]) for b in begin if first[i] <= b < first[i + 1]]
        if not len(x):
            continue
        inner = range(ls.GRAIN, len(x), ls.GRAIN)
        best = min(cost(x, [0, *c]) for r in range(len(inner) + 1) for c in itertools.combinations(inner, r))
        assert own[0] == 0 and abs(cost(x, own) - best) < 1e-6


def test_bounds_hold_and_blocks_are_skipped():
    rng = np.random.default_rng(6)
    n = 6000
    counts = rng.poisson([0.02] * 8 + [0.5] * 4, size=(n, 12))
    counts[1234, :] = 1  # one text that stands out
    texts, term = np.nonzero(counts)
    shard = ls.Shard(np.arange(n), counts.sum(axis=1) + 1, texts, term, counts[texts, term], 12, n, int(counts.sum() + n))
    terms, weight = np.arange(12), rng.integers(1, 50, size=12)
    exact = shard.scores(np.arange(n), terms, weight)
    assert (shard.bounds(terms, weight) >= exact).all()
    doc, score, looked = shard.search(terms, weight, 1, 1)
    assert doc.tolist() == [1234] and score.tolist() == [exact.max()]
    assert looked < n / 4
    sizes = np.diff(np.append(shard.from_doc, n))
    assert len(set(sizes.tolist())) > 3  # blocks of several sizes


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (None, "a", 6, "y"), (1, "a b", 7, "z"), (2, "A", 8, None)], "doc_id long, text string, score long, item_id string")
    items = spark.createDataFrame([(7, "a", "t"), (None, "a", "t")], "item_id long, text string, doc_id string")
    got = rows(ls.search(docs, items))
    want = plain([(0, "a b"), (1, "a b"), (2, "a")], [(7, "a")])
    assert [(r["doc_id"], r["score"]) for r in got] == [({0: 1, 1: 1, 2: 2}[i], s) for _, _, i, s in sorted(want)]
    assert rows(ls.search(docs.limit(0), items)) == [] and rows(ls.search(docs, items.limit(0))) == []
