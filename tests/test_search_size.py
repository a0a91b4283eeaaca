"""What a search of vectors holds, and that pieces of it give what the whole would."""

import numpy as np
import pytest

from inkmill.operators import embed, vector


@pytest.mark.parametrize("cells", [40, 1 << 20])
def test_small_pieces(spark, monkeypatch, cells):
    """Similarities are held a few at a time; ties at the borders of pieces go to the smaller id, also for text ids."""
    monkeypatch.setattr(vector, "CELLS", cells)
    monkeypatch.setattr(vector, "HITS", 10)
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, size=(90, 4)).astype(float)
    x[10:30] = x[40]
    df = spark.createDataFrame([(f"i{i:02d}", [float(v) for v in row]) for i, row in enumerate(x)], "id string, vector array<double>")
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n == 0, 1, n)
    s = np.round(u @ u.T, 9)
    for skip in (True, False):
        found = vector.top_k_batch(df, df.where("id like '%5'").selectExpr("id as query_id", "vector"), 4, skip_self=skip, places=9).collect()
        assert len(found) == 36
        for q in range(5, 90, 10):
            want = sorted((i for i in range(90) if not (skip and i == q)), key=lambda i: (-s[q, i], i))[:4]
            assert [r["id"] for r in sorted((r for r in found if r["query_id"] == f"i{q:02d}"), key=lambda r: r["rank"])] == [f"i{i:02d}" for i in want]


def test_sparse_rows_are_searched_as_they_are(spark):
    texts = spark.createDataFrame([(i, f"w{i % 5} w{i % 7} w{i % 2} common") for i in range(60)] + [(60, ""), (61, None)], "id long, text string")
    sparse = embed.tfidf_sparse(texts, embed.tfidf_fit(texts, 12))
    whole = embed.dense(sparse, 12)
    asked = lambda t: t.where("id % 9 = 0 or id = 60").withColumnRenamed("id", "query_id")
    key = lambda d: sorted((r["query_id"], r["rank"], r["id"], round(r["similarity"], 9)) for r in d.collect())
    assert key(vector.top_k_batch(sparse, asked(sparse), 5, skip_self=False, places=9)) == key(vector.top_k_batch(whole, asked(whole), 5, skip_self=False, places=9))
