"""The join of sparse rows by kind, against brute force; words counted in tasks, against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkmill.operators import embed, integrate, vector


def languages(n=5000, places=90, seed=12):
    """Counts of words of three languages, some rows of two, long and short, near copies, empty rows."""
    rng = np.random.default_rng(seed)
    x = np.zeros((n, places), np.int64)
    for i in range(n):
        own = rng.integers(3)
        for p in 30 * own + np.minimum(rng.geometric(0.1, size=rng.integers(1, 120)) - 1, 29):
            x[i, p if rng.random() > 0.02 * (i % 2) else rng.integers(places)] += 1
        if i % 10 == 1:
            x[i] = x[i - 1]
            x[i, rng.integers(places)] += 1
    x[::50] = 0
    return x


def table(x, book, first=0):
    kept = [np.flatnonzero(r) for r in x]
    return pa.table({
        "id": pa.array(range(first, first + len(x))), "book": pa.array(book, pa.string()),
        "p": pa.array([k.tolist() for k in kept], pa.list_(pa.int16())), "x": pa.array([r[k].tolist() for r, k in zip(x, kept)], pa.list_(pa.int32())),
    })


@pytest.mark.parametrize("threshold", [0.4, 0.7, 0.9])
def test_rows_by_kind_tell_all_pairs(threshold):
    x = languages()
    idf = (1 + np.arange(90) / 90).tolist()
    draw = np.random.default_rng(4)
    book = [None if i % 31 == 0 else f"b{0 if draw.random() < 0.4 else i % 4}" for i in range(len(x))]
    w = np.where(x > 0, (1 + np.log(np.maximum(x, 1))) * idf, 0)
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
    s = w @ w.T
    number = np.array([-1 if b is None else int(b[1]) for b in book])
    want = np.argwhere((s >= threshold) & (number[:, None] < number[None]) & (number[:, None] >= 0))
    half = len(x) // 2
    parts = table(x[:half], book[:half]), table(x[half:], book[half:], half)
    join = vector._multiplied(threshold, 300, [], idf, None)
    found = pa.concat_tables(pa.Table.from_batches(list(join(list(p))) or [], schema=None) for p in ([parts[0]], [parts[1]], parts)).to_pydict()
    got = dict(zip(zip(found["id1"], found["id2"]), found["similarity"]))
    assert len(found["id1"]) == len(got) == len(want) > 1000 and set(got) == set(map(tuple, want.tolist()))
    assert max(abs(got[i, j] - s[i, j]) for i, j in map(tuple, want[::97].tolist())) < 1e-12
    assert all(book[i] == a and book[j] == b for (i, j), a, b in zip(got, found["book1"], found["book2"]))
    told = vector._Told(["id2", "book1"], (0.8,))
    summed = pa.Table.from_batches(list(vector._multiplied(threshold, 300, [], idf, told)(list(parts)))).to_pydict()
    own = Counter((j, book[i], int(v >= 0.8)) for (i, j), v in got.items() if (i < half) != (j < half))
    assert dict(zip(zip(summed["id2"], summed["book1"], summed["band"]), summed["n"])) == own


def test_rows_that_cannot_reach_are_not_multiplied():
    x = languages()
    one = vector._Side(table(x, ["a"] * len(x)), np.ones(90))
    arranged, _ = vector._arranged([one], np.arange(len(x)) % 5, 300)
    pairs = [(p, q) for p in arranged.pieces for q in arranged.pieces]
    for threshold, most in ((0.7, 0.6), (0.9, 0.45)):
        kept = sum(int((p.reach(q) >= threshold).sum()) * int((q.reach(p) >= threshold).sum()) for p, q in pairs)
        assert kept < most * len(arranged.number) ** 2
    for p, q in pairs[::7]:  # a bound is one
        s = p.dense(np.ones(len(p.reach(q)), bool)) @ q.dense(np.ones(len(q.reach(p)), bool)).T
        assert (s.max(axis=1) <= p.reach(q) + 1e-6).all() and (s.max(axis=0) <= q.reach(p) + 1e-6).all()


def test_words_counted_in_tasks(spark):
    rng = np.random.default_rng(9)
    words = ["red", "Green", "blue", "x", "Été", "ß", "12", "a_b", "第一章", "no", "of"]
    ends = [" ", "-", ".\n", "\u3000", "'"]
    texts = ["".join(words[j] + ends[k] for j, k in zip(rng.integers(11, size=m), rng.integers(5, size=m))) for m in rng.integers(0, 9, size=2500)] + [None, "", " x ", "red" * 40_000]
    df = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(texts)], "id long, text string, kept array<int>").coalesce(1)
    each = []
    for t in texts:
        u = re.findall(r"\w{2,}", (t or "").lower())
        each.append(Counter([*u, *(f"{a} {b}" for a, b in zip(u, u[1:]))]))
    tf, df_ = Counter(), Counter()
    for c in each:
        tf.update(c)
        df_.update(c.keys())
    want = sorted(tf, key=lambda t: (-tf[t], t.encode()))[:30]
    fitted = embed.tfidf_fit(df, 30)
    got = {r["term"]: r for r in fitted.collect()}
    assert sorted(got) == sorted(want)
    assert all((r["tf"], r["df"]) == (tf[t], df_[t]) and r["idf"] == pytest.approx(math.log((1 + len(texts)) / (1 + df_[t])) + 1) for t, r in got.items())
    rows, idf = embed.tfidf_counts(df, fitted)
    terms = sorted(want, key=lambda t: t.encode())
    assert rows.columns == ["id", "kept", "at", "n"] and len(idf) == 30
    for r in rows.collect():
        assert r["kept"] == [r["id"]] and dict(zip(r["at"], r["n"])) == {p: each[r["id"]][t] for p, t in enumerate(terms) if t in each[r["id"]]} and r["at"] == sorted(r["at"])


def test_actions_without_nodes(spark):
    """Counts need no node: pairs told together by the edges only come to the same."""
    pairs = spark.createDataFrame([(i % 2, 10 + i % 3, s) for i, s in enumerate([0.9, 0.8999995, 0.89999949, 0.7, 0.6999995, 0.3])], "id1 long, id2 long, s double")
    band = " + ".join(f"int(s >= {e!r}D)" for e in integrate.EDGES)
    pairs = pairs.selectExpr("id2", "s", f"{band} as band")
    told = [pairs.groupBy(*by, "band").agg(F.count("*").alias("n"), F.max("s").alias("most")) for by in (["id2"], [])]
    counts = [tuple(integrate.decision_counts(integrate.told_outcome(t)).first()) for t in told]
    assert counts[0] == counts[1] == (6, 2, 3, 1)
