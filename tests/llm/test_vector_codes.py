"""Vector codes: against a plain Lloyd in whole numbers, fewer distances than a full scan, odd tables."""

import hashlib
import math

import numpy as np
import pytest

from inkmill.llm import vector_codes as vc
from tests.llm.data import rows

VECTORS = "vec_id long, embedding array<double>, label int"


def plain(table, parts, entries, rounds):
    """(code, error, digest) of rows (vec_id, embedding) in order of vec_id, without bounds."""
    whole = [[math.floor(4096 * x) for x in e] for _, e in table]
    width = len(whole[0]) // parts
    codes, errors, books = [""] * len(whole), [0] * len(whole), []
    for p in range(parts):
        x = [w[p * width : (p + 1) * width] for w in whole]
        book = [list(e) for e in x[:entries]]
        for r in range(rounds + 1):
            d = [[sum((a - b) ** 2 for a, b in zip(v, e)) for e in book] for v in x]
            own = [min(range(len(book)), key=lambda j, i=i: (d[i][j], j)) for i in range(len(x))]
            if r < rounds:
                for j in set(own):
                    members = [x[i] for i in range(len(x)) if own[i] == j]
                    book[j] = [sum(c) // len(members) for c in zip(*members)]
        for i in range(len(x)):
            codes[i] += f"{own[i]:02x}"
            errors[i] += d[i][own[i]]
        books += [c for e in book for c in e]
    return codes, errors, hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


def cases():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(7, 8))
    clustered = [(centres[i % 7] + 0.05 * rng.normal(size=8)).tolist() for i in range(150)]
    ties = rng.integers(-2, 3, size=(120, 8)) / 4096  # many equal distances
    return {"clustered": clustered, "ties": ties.tolist(), "few": rng.normal(size=(3, 8)).tolist(), "copies": [[0.5] * 8] * 20 + [[-0.25] * 8] * 5 + [[1e-9] * 8]}


@pytest.mark.parametrize("name", ["clustered", "ties", "few", "copies"])
@pytest.mark.parametrize("groups", [1, 3])
def test_equals_plain_lloyd(spark, name, groups):
    table = list(enumerate(cases()[name]))
    labels = [None if i % 5 == 0 else i % 3 for i, _ in table]
    df = spark.createDataFrame([(i, e, lab) for (i, e), lab in zip(table, labels)], VECTORS).repartition(3)
    got = sorted(rows(vc.compress(df, parts=2, entries=6, rounds=4, groups=groups, share_labels=1 if groups == 1 else 100)), key=lambda r: r["vec_id"])
    codes, errors, digest = plain(table, 2, 6, 4)
    assert [r["code"] for r in got] == codes and [r["error"] for r in got] == errors
    assert {r["codebooks_sha256"] for r in got} == {digest}
    sums = {lab: sum(e for e, x in zip(errors, labels) if x == lab) for lab in set(labels)}
    assert [r["label_error"] for r in got] == [sums[lab] for lab in labels]


def test_groups_are_passed_over(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    codes, _, took = vc.learn(df)
    full = codes.count() * 8 * 16
    assert took[0] == full and max(took[1:]) < 0.8 * full


def test_bounds_enclose_true_distances():
    rng = np.random.default_rng(3)
    x = rng.integers(-3000, 3000, size=(400, 4))
    entries = x[:10].copy()
    group = vc.grouped(entries, 3)
    own, upper, lower = vc.first_assignment(x, entries, group)
    for _ in range(5):
        after = entries + rng.integers(-200, 200, size=entries.shape)
        drift = vc.Codebooks([entries], [group]).drift(vc.Codebooks([after], [group]))[0]
        own, upper, lower, _ = vc.reassign(x, own, upper, lower, after, group, drift)
        entries = after
        d = vc.distances(x, entries)
        assert (own == d.argmin(axis=1)).all()
        true = np.sqrt(d.astype(float))
        assert (upper >= true[np.arange(400), own]).all()
        true[np.arange(400), own] = np.inf
        for g in range(group.max() + 1):
            assert (lower[:, g] <= true[:, group == g].min(axis=1)).all()


def test_odd_tables(spark):
    odd = [(1, [0.5] * 8, 1), (None, [0.25] * 8, None), (2, None, 1), (3, [None] + [0.0] * 7, 1), (4, [float("nan")] * 8, 1), (5, [float("inf")] * 8, 1), (6, [1.0] * 7, 1), (7, [], 1), (1, [0.5] * 8, 2), (8, [0.0] * 8, None)]
    df = spark.createDataFrame([(*r, "c") for r in odd], VECTORS + ", code string")
    got = rows(vc.compress(df, parts=2, entries=2, rounds=2))
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"]) for r in got) == [-1, 1, 1, 8]
    assert rows(vc.compress(df.limit(0))) == []
    assert rows(vc.compress(df.where("vec_id = 2"))) == []
    assert len({r["label_error"] for r in rows(vc.compress(df.drop("label"), parts=2, entries=2))}) == 1
    with pytest.raises(ValueError):
        vc.compress(df, parts=3)
    with pytest.raises(Exception, match="cannot be coded"):
        vc.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], VECTORS))
