"""Nearest neighbours: recall against brute force, exact scores, odd vectors."""

import numpy as np
import pytest

from inkmill.llm import ann
from tests.llm.data import rows

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(ids, x, query, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u[ids.index(query)]
    return sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-round(s[i], 12), ids[i]))[:k], s


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    table = df.orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in table], np.array([r["embedding"] for r in table], dtype=np.float64)
    found = rows(ann.nearest(df, "vec_id % 50 = 0", block_rows=200, query_block=4))
    hit = total = 0
    for q in [i for i in ids if i % 50 == 0]:
        want, s = brute(ids, x, q)
        got = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
        assert [r["score"] for r in got] == pytest.approx([s[ids.index(r["vec_id"])] for r in got], abs=1e-12)
        hit, total = hit + len({r["vec_id"] for r in got} & {ids[i] for i in want}), total + 5
    assert hit / total >= 0.9


def test_recall_with_production_parameters(spark):
    """Blocks hold far more vectors than ``enough``, so most codes are never reranked."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = df.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], dtype=np.float64)
    assert len(ids) > 4 * 401
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    found = {}
    for r in rows(ann.nearest(df, "vec_id % 50 = 0")):
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    for i in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[i]
        s[i] = -2
        hit, total = hit + len(found[ids[i]] & set(ids[np.argsort(-s)[:5]].tolist())), total + 5
    assert total >= 150 and hit / total >= 0.9
    print("recall", hit / total)


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 256, (500, 4)).astype(np.uint8)
    index = ann.MultiIndex(codes)
    apart = ann._BITS_OF[codes ^ codes[0]].sum(axis=1)
    for radius in range(33):
        assert index.within(codes[0], radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_odd_vectors_and_ties(spark):
    good = [(i, [float(i % 7 + 1), 1.0, 0.0], 0) for i in range(100, 160)]
    bad = [(0, None, 0), (50, [0.0, 0.0, 0.0], 0), (200, [float("nan"), 1.0, 1.0], 0), (250, [1.0, None, 1.0], 0), (300, [float("inf"), 1.0, 1.0], 0)]
    found = rows(ann.nearest(spark.createDataFrame(good + bad, VECTORS), "vec_id % 50 = 0"))
    assert {r["query_id"] for r in found} == {100, 150}
    first = [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == 100), key=lambda r: r["rank"])]
    assert first == [i for i in range(101, 160) if i % 7 == 100 % 7][:5]
    few = rows(ann.nearest(spark.createDataFrame(good[:3], VECTORS), "vec_id % 50 = 0"))
    assert len(few) == 2 and ann.nearest(spark.createDataFrame([], VECTORS), "true").count() == 0
    assert ann.nearest(spark.createDataFrame(bad, VECTORS), "true").count() == 0


def test_repeated_ids_lengths_and_clashing_columns(spark):
    """A query passes over its own row alone, each query row has its own ranks, the commonest length counts."""
    table = [(0, [1.0, 0.0], 0), (50, [1.0, 0.0, 0.0], 0), (50, [1.0, 0.0, 0.0], 0), (50, [0.0, 1.0, 0.0], 0), (7, [1.0, 0.1, 0.0], 0), (7, [1.0, 0.1, 0.0], 0), (None, [1.0, 0.0, 0.0], 0)]
    clash = spark.createDataFrame(table, VECTORS).selectExpr("*", "'x' score", "'x' rank", "'x' query_id", "'x' block", "'x' part")
    found = rows(ann.nearest(clash, "vec_id % 50 = 0", k=4))
    got = sorted(tuple((r["rank"], r["vec_id"], round(r["score"], 6)) for r in found[i : i + 1]) for i in range(len(found)))
    near = round(1 / np.sqrt(1.01), 6)
    side = round(0.1 / np.sqrt(1.01), 6)
    twice = [((1, 50, 1.0),), ((2, 7, near),), ((3, 7, near),), ((4, 50, 0.0),)]
    once = [((1, 7, side),), ((2, 7, side),), ((3, 50, 0.0),), ((4, 50, 0.0),)]
    assert {r["query_id"] for r in found} == {50} and got == sorted(twice * 2 + once)
