"""Language identification and toxicity: held-out accuracy, exact neighbours, edge cases."""

import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmill.llm import language_id, queries, toxicity
from tests.llm.data import DOCS, documents, rows

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = rows(queries.op2_language_id(spark, SF))
    held = [r for r in found if r["held_out"]]
    assert len(found) == len(truth) and 250 < len(held) < 420
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edges(spark):
    texts = ["the cat and the dog are here", "le chat et le chien sont ici"] * 30 + [None, "", "123 ... !", "é", "日本", "the " * 40_000]
    docs = documents(spark, texts, ["en", "fr"] * 30 + [None] * 6).withColumn("score", F.lit("clash"))
    model = language_id.train(docs.select("text", "lang", F.lit(0.0).alias("draw")))
    got = sorted(rows(language_id.predict(docs, model)), key=lambda r: r["doc_id"])
    assert [r["lang_pred"] for r in got[:60]] == ["en", "fr"] * 30 and got[65]["lang_pred"] == "en"
    assert [(r["lang_pred"], r["score"], r["accepted"]) for r in got[60:63]] == [("und", 0.0, False)] * 3
    assert {r["lang_pred"] for r in got[63:65]} <= {"en", "fr"}
    none = language_id.train(docs.where("lang = 'xx'").select("text", "lang", F.lit(0.0).alias("draw")))
    assert {r["lang_pred"] for r in rows(language_id.predict(docs, none))} == {"und"}
    assert language_id.predict(spark.createDataFrame([], DOCS), model).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        t = np.unique(rng.integers(0, 30, rng.integers(0, 6)))
        w = rng.choice([1.0, 1.0, 2.0, 0.5], len(t))
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    index = toxicity.BlockMax(30, vectors)
    dense = np.zeros((700, 30))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(0, 700, 7):
        t, w = vectors[q]
        s = np.round(dense @ dense[q], 9)
        for leave in (-1, q):
            own = [i for i in range(700) if s[i] > 0 and i != leave]
            want = sorted(own, key=lambda i: (-s[i], i))[:15]
            found, score = index.nearest(t, w, 15, leave)
            assert found.tolist() == want and score == pytest.approx(s[want])


def test_toxicity_learns_and_handles_edges(spark):
    rng = np.random.default_rng(4)
    clean = [" ".join(rng.choice(["sun", "rain", "tree", "house", "road", "lake"], 30)) for _ in range(300)]
    texts = [c + (" vileword" if i % 6 == 0 else "") for i, c in enumerate(clean)] + [None, "", "!!!", "VILEWORD", "sun " * 50_000 + "vileword", clean[1]]
    docs = documents(spark, texts).withColumn("predicted", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 300, 2)] + [(1, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in rows(toxicity.score(docs, model))}
    held = [got[i] for i in range(1, 300, 2)]
    assert all(r["predicted"] == 0 for r in held)  # none of the odd ones is toxic
    assert got[303]["predicted"] == got[304]["predicted"] == 1 and got[303]["evidence"][0]["toxic"] == 1
    assert got[300]["score"] == got[301]["score"] == got[302]["score"] < 0.5 and got[300]["evidence"] == []
    assert got[305]["score"] == got[1]["score"]
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(texts) - 52
    nothing = toxicity.fit(docs, labels.where("doc_id = -1"))
    assert {r["score"] for r in rows(toxicity.score(docs, nothing))} == {0.0}
    assert toxicity.score(spark.createDataFrame([], DOCS), model).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels, sample=20)).count() == len(texts)


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [1.0, 2.5, 4.0]


def _plain_terms(text):
    clean = re.sub(r"[^a-z0-9]", " ", (text or "").lower())
    buf = f" {clean}      "
    return Counter([("word", w) for w in clean.split()] + [("gram", buf[i : i + 5]) for i in range(len(buf) - 4) if " " not in buf[i + 1 : i + 4]])


def _plain_toxicity(texts, labels):
    """Scores by the definitions: every example is compared, in plain Python."""
    counts = [_plain_terms(t) for t in texts]
    size, positive = len(labels), sum(labels.values())
    rate = positive / size
    df, dt = Counter(), Counter()
    for i, toxic in labels.items():
        df.update(counts[i].keys())
        dt.update(counts[i].keys() if toxic else ())
    tried = {t for t in df if df[t] >= 3}

    def g2(t):
        cells = [(dt[t], df[t] * positive), (df[t] - dt[t], df[t] * (size - positive)), (positive - dt[t], (size - df[t]) * positive), (size - positive - df[t] + dt[t], (size - df[t]) * (size - positive))]
        return 2 * sum(seen * math.log(seen * size / by) for seen, by in cells if seen)

    chosen = {t for t in tried if g2(t) > max(15, 2 * math.log(max(2, len(tried)))) and dt[t] / df[t] > min(3 * rate, (1 + rate) / 2)}

    def vector(i):
        w = {t: (1 + math.log(n)) * (math.log((1 + size) / (1 + df[t])) + 1) for t, n in counts[i].items() if t in chosen}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    examples = [(i, vector(i), labels[i]) for i in sorted(labels)]

    def raw(v, leave=None):
        near = [(round(sum(x * e.get(t, 0) for t, x in v.items()), 9), n) for n, (i, e, _) in enumerate(examples) if i != leave]
        best = sorted((p for p in near if p[0] > 0), key=lambda p: (-p[0], p[1]))[:15]
        votes = [(math.exp(-(1 - min(s, 1)) / 0.35), examples[n][2]) for s, n in best]
        return round((sum(w * y for w, y in votes) + rate) / (sum(w for w, _ in votes) + 1), 12)

    left = [(raw(v, i), y) for i, v, y in examples]
    xs = sorted({x for x, _ in left})
    own = [[y for x, y in left if x == a] for a in xs]

    def mean(a, b):
        return Fraction(sum(map(sum, own[a : b + 1])), sum(map(len, own[a : b + 1])))

    fit = [max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
    blocks = {}
    for x, y, o in zip(xs, fit, own):
        blocks.setdefault(y, []).extend([x] * len(o))
    return [float(np.interp(raw(vector(i)), [np.mean(b) for b in blocks.values()], [float(y) for y in blocks])) for i in range(len(texts))], len(chosen)


def test_toxicity_scores_by_brute_force(spark):
    rng = np.random.default_rng(12)
    calm, rude = ["sunny", "rain", "tree", "house", "road", "lake", "Book-7"], ["vileword", "nastier", "grudge", "spite"]
    texts, truth = [], []
    for i in range(90):
        toxic = i % 3 == 0
        words = list(rng.choice(calm, 8)) + list(rng.choice(rude, rng.integers(1, 4) if toxic != (i % 10 == 0) else 0))
        texts.append(" ".join(rng.permutation(words)))
        truth.append(int(toxic))
    texts += [None, "", "vileword", "sunny spite!", texts[3]]
    known = {i: truth[i] for i in range(90) if i % 5}
    labels = spark.createDataFrame(list(known.items()), "doc_id long, toxic int")
    docs = documents(spark, texts)
    got = {r["doc_id"]: r["score"] for r in rows(toxicity.score(docs, toxicity.fit(docs, labels)))}
    want, chosen = _plain_toxicity(texts, known)
    assert chosen > 5 and len(set(np.round(want, 6))) > 3
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-6)
