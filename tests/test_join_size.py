"""What similarity joins move: rows are copied a bounded number of times, pairs are neither joined nor kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmill import workflows
from inkmill.operators import embed, integrate, vector
from tests.test_vectors import sparse_table


def test_copies_of_a_row_do_not_grow(spark):
    assert vector._blocks(1_000, 5e5, 2048) == 1
    assert vector._blocks(100_000, 5e7, 2048) == vector._blocks(1_000_000, 5e8, 2048) == vector.BLOCKS
    assert vector._blocks(10_000_000, 5e9, 2048) <= 5e9 / vector.BLOCK_BYTES + 1  # what a task holds is bounded


def brute(x, book, threshold):
    s = x @ x.T
    return {(i, j): s[i, j] for i in range(len(x)) for j in range(len(x)) if book[i] < book[j] and s[i, j] >= threshold}


def test_few_common_places_go_by_blocks_and_columns_come_along(spark):
    """Lists of the commonest words would multiply more pairs than there are: each pair is multiplied once, and what
    the items bring is on the pairs."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["red", "green", "blue", "black", "white", "grey"], size=4)) for _ in range(120)]
    df = spark.createDataFrame([(i, f"b{i % 3}", t, len(t)) for i, t in enumerate(texts)], "id long, book string, text string, len int")
    items = embed.tfidf_sparse(df, embed.tfidf_fit(df, 12))
    rows = items.orderBy("id").collect()
    x = np.zeros((120, 12))
    for r in rows:
        x[r["id"], r["at"]] = r["weight"]
    found = vector.similar_pairs(items, 0.8, block=16)
    assert "led" not in found._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0] and found.columns[-2:] == ["len1", "len2"]
    got = found.collect()
    want = brute(x, [i % 3 for i in range(120)], 0.8)
    assert len(got) == len(want) > 10 and {(r["id1"], r["id2"]): r["similarity"] for r in got} == pytest.approx(want)
    assert all(r["len1"] == len(texts[r["id1"]]) and r["len2"] == len(texts[r["id2"]]) for r in got)


def test_lists_in_blocks(spark):
    """Lists cut into blocks and multiplied in tiles tell each pair once."""
    rng = np.random.default_rng(4)
    n, dims = 200, 400
    x = np.zeros((n, dims))
    for i in range(n):
        x[i, rng.choice(dims - 1, size=4, replace=False)] = 1 + rng.random(4)
        x[i, dims - 1] = 0.5
    x[1::2] = x[::2] * (1 + 0.3 * rng.random((n // 2, dims)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 2, [int(p) for p in np.nonzero(v)[0]], [float(w) for w in v[v != 0]]) for i, v in enumerate(x)], "id long, book int, at array<int>, weight array<double>")
    found = vector.similar_pairs(df, 0.6, block=3)
    assert "list" in found._jdf.queryExecution().analyzed().toString()
    got = found.collect()
    want = brute(x, [i % 2 for i in range(n)], 0.6)
    assert len(got) == len(want) >= n // 2 and {(r["id1"], r["id2"]): r["similarity"] for r in got} == pytest.approx(want)


def test_outcome_of_decisions(spark):
    nodes = spark.createDataFrame([(f"n{i}", "d" * i) for i in range(1, 7)], "id string, definition string")
    rows = [("n1", "n2", 0.95), ("n3", "n2", 0.92), ("n3", "n4", 0.5), ("n5", "n6", 0.8), ("n6", "n5", 0.75)]
    pairs = spark.createDataFrame([(*r, int(r[0][1]), int(r[1][1])) for r in rows], "node1_id string, node2_id string, confidence double, len1 int, len2 int")
    plain = integrate.decide(pairs.drop("len1", "len2"), nodes)
    brought = integrate.decide(pairs, nodes)
    assert "Join" not in brought._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, brought.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    told = integrate.outcome(brought)
    assert tuple(integrate.decision_counts(told).first()) == tuple(integrate.decision_counts(plain).first()) == (5, 2, 2, 1)
    left = lambda d: sorted(r["id"] for r in integrate.apply_decisions(nodes, d).collect())
    assert left(told) == left(plain) == ["n1", "n3", "n5", "n6"]
    assert told.count() <= 3 and tuple(integrate.decision_counts(told.limit(0)).first()) == (0, 0, 0, 0)


def test_sparse_rows_of_one_book_or_none(spark):
    _, df = sparse_table(spark)
    assert vector.similar_pairs(df.withColumn("book", F.lit("b")), 0.5, block=16).count() == 0
    assert vector.similar_pairs(df.withColumn("book", F.lit(None).cast("string")), 0.5).count() == 0


def test_aligned_pairs_are_shuffled_only_to_be_ordered(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i % 2)]) for i in range(8)], "id long, vector array<double>")
    nodes = spark.createDataFrame([(i, f"b{i % 2}", f"name {i}", f"text {i}") for i in range(8)], "id long, textbook_id string, name string, definition string")
    for ordered, exchanges in ((True, 1), (False, 0)):
        found = workflows.align(nodes, vectors, ["b1", "b0"], 0.7, ordered=ordered)
        above = found._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
        assert above.count("Exchange") == exchanges and "Join" not in above
        rows = found.collect()
        assert rows and all(r["node1_name"] == f"name {r['node1_id']}" and r["node2_name"] == f"name {r['node2_id']}" and r["book1"] == "b1" for r in rows)
    asked = workflows.align(nodes, vectors, ["b1", "b0"], 0.7, provider=lambda prompts: ['{"is_equivalent": true, "reason": "' + p.split("text ")[-1][0] + '"}' for p in prompts])
    assert all(r["is_equivalent"] and r["reason"] == str(r["node2_id"]) for r in asked.collect())


def words_table(spark, n=150):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["red", "green", "blue", "black", "white", "grey"], size=3 + i % 3)) for i in range(n)]
    return spark.createDataFrame([(i, f"b{i % 3}", t) for i, t in enumerate(texts)], "id long, book string, text string")


@pytest.mark.parametrize("block", [16, 2048])
def test_counts_join_as_weights_do_and_are_what_is_copied(spark, block):
    texts = words_table(spark)
    vocabulary = embed.tfidf_fit(texts, 12)
    plain = {(r["id1"], r["id2"]): r["similarity"] for r in vector.similar_pairs(embed.tfidf_sparse(texts, vocabulary), 0.8, block=block).collect()}
    items, idf = embed.tfidf_counts(texts, vocabulary)
    found = vector.similar_pairs(items, 0.8, block=block, idf=idf)
    assert len(plain) > 100 and {(r["id1"], r["id2"]): r["similarity"] for r in found.collect()} == pytest.approx(plain)
    if block == 16:  # by blocks: no weight of eight bytes is copied, only a place and a count
        copied = vector.similar_pairs(items, 0.3, block=block, idf=idf)._jdf.queryExecution().analyzed().children().head()
        kinds = {f.name(): f.dataType().catalogString() for f in (copied.schema().apply(i) for i in range(copied.schema().size()))}
        assert kinds["p"] == "array<smallint>" and kinds["x"] == "array<int>"


@pytest.mark.parametrize("block", [16, 2048])
@pytest.mark.parametrize("by", [["id2"], ["book1", "book2"], ["id1", "book2"]])
def test_pairs_told_together(spark, by, block):
    texts = words_table(spark)
    items, idf = embed.tfidf_counts(texts, embed.tfidf_fit(texts, 12))
    edges = (0.85, 0.95)
    want = {}
    for r in vector.similar_pairs(items, 0.8, block=block, idf=idf).collect():
        want.setdefault((*(r[c] for c in by), sum(r["similarity"] >= e for e in edges)), []).append(r["similarity"])
    got = vector.similar_pairs(items, 0.8, block=block, idf=idf, by=by, edges=edges).collect()
    assert len(got) == len(want) > 3
    for r in got:
        s = want[(*(r[c] for c in by), r["band"])]
        assert r["n"] == len(s) and (r["total"], r["least"], r["most"]) == pytest.approx((sum(s), min(s), max(s)))
    assert vector.similar_pairs(items.limit(0), 0.8, idf=idf, by=by).collect() == []


def test_outcome_of_pairs_told_together(spark):
    """Rounded confidences decide, and the outcome is that of one decision a pair."""
    close = [0.9, 0.8999995, 0.89999949, 0.7, 0.6999995, 0.69999949, 0.3]
    pairs = spark.createDataFrame([(i % 2, 10 + i % 3, s) for i, s in enumerate(close)], "id1 long, id2 long, s double")
    band = " + ".join(f"int(s >= {e!r}D)" for e in integrate.EDGES)
    told = pairs.groupBy("id2", F.expr(band).alias("band")).agg(F.count("*").alias("n"), F.sum("s").alias("total"), F.min("s").alias("least"), F.max("s").alias("most"))
    each = integrate.decide(pairs.select(F.col("id1").cast("string").alias("node1_id"), F.col("id2").cast("string").alias("node2_id"), F.round("s", 6).alias("confidence"), F.lit(1).alias("len1"), F.lit(1).alias("len2")), pairs)
    outcome = integrate.told_outcome(told)
    assert tuple(integrate.decision_counts(outcome).first()) == tuple(integrate.decision_counts(each).first()) == (7, 2, 3, 2)
    gone = lambda d: sorted(r["id"] for r in integrate.removed_ids(d).collect())
    assert gone(outcome) == gone(each)


def test_compression_figures_move_no_text(spark):
    from inkmill.plans.registry import QUERIES

    plan = QUERIES["compression_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan
    for part in plan.split("Exchange hashpartitioning(")[1:]:
        beneath = next(line for line in part.splitlines()[1:] if "- " in line)
        assert "definition" not in beneath and "text#" not in beneath.split("length(text")[0]


def test_only_few_partitions_are_dealt_anew(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(100).select(F.col("id").cast("string").alias("text"))
    assert embed.spread(one.coalesce(1)).rdd.getNumPartitions() == 2 * cores
    nearly = one.repartition(cores // 2 + 1)
    assert embed.spread(nearly) is nearly


def test_rows_are_moved_once(spark):
    """The join of blocks shuffles no copies: every two blocks meet where they are kept, each block is one row."""
    texts = words_table(spark)
    items, idf = embed.tfidf_counts(texts, embed.tfidf_fit(texts, 12))
    found = vector.similar_pairs(items, 0.3, block=16, idf=idf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    packed = vector._packed(items.withColumnsRenamed({"at": "p", "n": "x"}), 10)
    blocks = packed.select(F.size("id").alias("n")).collect()
    assert len(blocks) <= 10 and sum(r["n"] for r in blocks) == 150
    told = vector.similar_pairs(items, 0.3, block=16, idf=idf, by=["id2"])
    assert told._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_blocks_keep_what_rows_bring(spark):
    """Nulls, names, arrays and rows without words come through the blocks."""
    rows = [(i, None if i % 7 == 0 else f"b{i % 3}", [i % 3, 3], [1, 2 + i % 2], None if i % 5 == 0 else f"né {i}", [i] * (i % 3)) for i in range(60)]
    items = spark.createDataFrame([*rows, (60, "b0", [], [], "none", [])], "id long, book string, p array<smallint>, x array<int>, name string, tags array<int>")
    packed = vector._packed(items, 4).toArrow().to_batches(max_chunksize=1)
    got = {r["id"]: r for k in packed if k.num_rows for r in vector._unpacked(k, "").to_pylist()}
    assert got == {r[0]: dict(zip(items.columns, r)) for r in [*rows, (60, "b0", [], [], "none", [])]}
    assert vector._packed(items.limit(0), 4).count() == 0
    found = vector.similar_pairs(items.withColumnsRenamed({"p": "at", "x": "n"}), 0.5, block=8, idf=[1.0, 1.0, 1.0, 1.0]).collect()
    assert found and all(r["name1"] == (None if r["id1"] % 5 == 0 else f"né {r['id1']}") and r["tags2"] == [r["id2"]] * (r["id2"] % 3) and r["book1"] < r["book2"] for r in found)
