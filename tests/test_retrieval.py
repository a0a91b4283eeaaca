"""BM25, rank fusion and evaluation against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from inkmill.operators import retrieval


def plain_bm25(texts, questions, k):
    docs = {i: re.findall(r"\w\w+", t.lower()) for i, t in texts if t is not None}
    docs = {i: u for i, u in docs.items() if u}
    mean = sum(map(len, docs.values())) / len(docs)
    out = []
    for q, text in questions:
        scores = Counter()
        for term in re.findall(r"\w\w+", (text or "").lower()):
            df = sum(term in u for u in docs.values())
            for i, u in docs.items():
                tf = u.count(term)
                if tf:
                    scores[i] += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(u) / mean))
        best = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:k]
        out += [(q, r + 1, i, pytest.approx(scores[i], abs=1e-8)) for r, i in enumerate(best)]
    return out


@pytest.fixture(scope="module")
def words():
    rng = np.random.default_rng(12)
    vocabulary, p = [f"w{i}x" for i in range(80)], 1 / np.arange(1, 81)
    texts = [" ".join(rng.choice(vocabulary, size=rng.integers(1, 60), p=p / p.sum())) for _ in range(200)]
    return texts + texts[:20] + ["", None, "a b", "w0x " * 2000]


@pytest.mark.parametrize("lead", [1, 3, 50])
def test_bm25_equals_plain_scores(spark, words, lead):
    df = spark.createDataFrame(list(enumerate(words)), "id long, text string")
    questions = [(1, words[3]), (2, "w0x w0x w79x"), (3, "unknown words"), (4, None), (5, "w0x"), (6, words[50] + " " + words[60])]
    asked = spark.createDataFrame(questions, "question_id long, question string")
    got = retrieval.bm25(retrieval.postings(df), retrieval.collection(df), asked, 6, lead=lead)
    assert sorted(tuple(r) for r in got.select("question_id", "rank", "id", "score").collect()) == plain_bm25(list(enumerate(words)), questions, 6)


def test_small_terms_bring_in_no_candidates(spark):
    """Texts with only the common word are never scored, and the result is as it would be."""
    texts = [f"common word{i}" for i in range(300)] + ["common rare rare rare"] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(1, "common rare")], "question_id long, question string")
    got = retrieval.bm25(retrieval.postings(df), retrieval.collection(df), asked, 3, lead=1).collect()
    assert [(r["rank"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 300), (2, 301), (3, 302)]
    assert [r["score"] for r in got] == [e[3] for e in plain_bm25(list(enumerate(texts)), [(1, "common rare")], 3)]


def test_postings(spark):
    df = spark.createDataFrame([(1, "The the CAT"), (2, None), (3, "x y"), (4, "")], "id long, text string")
    assert sorted(tuple(r) for r in retrieval.postings(df).collect()) == [("cat", 1, 1, 3), ("the", 1, 2, 3)]
    assert tuple(retrieval.collection(df).first()) == (1, 3.0)


def test_fusion_and_its_ties(spark):
    ddl = "question_id long, rank int, id long"
    one = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 5)], ddl)
    two = spark.createDataFrame([(1, 1, 11), (1, 2, 10), (1, 3, 9), (3, 1, 4)], ddl)
    got = sorted(tuple(r) for r in retrieval.fuse([one, two], 2).collect())
    both = round(1 / 61 + 1 / 62, 9)
    assert got == [(1, 1, 10, both), (1, 2, 11, both), (2, 1, 5, round(1 / 61, 9)), (3, 1, 4, round(1 / 61, 9))]
    assert len(retrieval.fuse([one], 5).collect()) == 3 and retrieval.fuse([one.limit(0), two.limit(0)]).collect() == []


def test_evaluation(spark):
    ranked = spark.createDataFrame([("a", 1, 1, 7), ("a", 1, 2, 8), ("a", 2, 1, 1), ("b", 1, 3, 8), ("b", 1, 9, 7)], "config string, question_id long, rank int, id long")
    judged = spark.createDataFrame([(1, 8, 2), (1, 7, 1), (1, 8, 1), (2, 9, 1), (3, 1, 0)], "question_id long, id long, gain int")
    got = {r["config"]: r for r in retrieval.evaluate(ranked, judged, 5).collect()}
    ideal = 3 + 1 / math.log2(3)
    assert got["a"]["questions"] == got["b"]["questions"] == 2
    assert [got["a"][c] for c in ("recall", "mrr", "ndcg")] == pytest.approx([0.5, 0.5, (1 + 3 / math.log2(3)) / ideal / 2])
    assert [got["b"][c] for c in ("recall", "mrr", "ndcg")] == pytest.approx([0.25, 1 / 6, 3 / 2 / ideal / 2])


def test_runs_of_words_held(spark):
    """Whole runs, at either end, across rows not, and short texts as a whole."""
    texts = ["a b c d", "x a b c", "a  b\tc\n", "a b", " a b ", "b a b c a b c", "a b x c", "", None, "c", "aa b c", "a b c\u00a0d"]
    runs = ["a b", "a b c", "b c d", "c", "z z z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    want = set()
    for i, t in enumerate(texts):
        u = [w for w in re.split("[ \t-\r]+", t or "") if w]
        want |= {(i, r) for r in runs for j in range(max(1, len(u) - 2)) if u and " ".join(u[j : j + 3]) == r}
    got = [tuple(r) for r in retrieval.holding(df, runs, 3, "[ \\t-\\r]+").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) == 8


def test_only_terms_asked_leave_the_task(spark, words):
    df = spark.createDataFrame(list(enumerate(words)), "id long, text string")
    asked = spark.createDataFrame([(1, "w0x W3x unknown"), (2, None)], "question_id long, question string")
    terms = retrieval.terms_asked(asked)
    assert terms == ["unknown", "w0x", "w3x"]
    whole = {tuple(r) for r in retrieval.postings(df).collect()}
    assert {tuple(r) for r in retrieval.postings(df, terms).collect()} == {r for r in whole if r[0] in terms}
    u = {i: re.findall(r"\w\w+", t.lower()) for i, t in enumerate(words) if t}
    assert whole == {(w, i, n, len(v)) for i, v in u.items() for w, n in Counter(v).items()}
    assert retrieval.collection(df.limit(0)).collect()[0]["n_texts"] == 0
