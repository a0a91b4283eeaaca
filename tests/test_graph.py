"""Graph, integration and compression operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from inkmill.operators import graph, integrate

NODE = "id string, name string, definition string, category string, textbook_id string, frequency long, seq long"
RELATION = "source string, target string, relation_type string, description string, confidence double, seq long"


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [("n1", "炎症", "d" * 22, "核心概念", "book_1", 1, 1), ("n2", "免疫", "d" * 18, "定理", "book_1", 2, 2), ("n3", "炎症反应", "e" * 33, "核心概念", "book_2", 1, 3), ("n4", "免疫系统", "e" * 23, "方法", "book_2", 1, 4)]
    return spark.createDataFrame(rows, NODE)


@pytest.fixture(scope="module")
def relations(spark):
    return spark.createDataFrame([("n1", "n2", "prerequisite", "", 0.9, 1), ("n2", "n3", "parallel", "", 0.8, 2), ("n1", "n2", "prerequisite", "later", 0.1, 3), ("n4", "gone", "parallel", "", 1.0, 4)], RELATION)


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_merge(spark, relations):
    rows = [("a", "b", "xx", "c1", "t", 3, 1), ("a", "b", "yyy", "c2", "t", 9, 2), ("a", "b", "zzz", "c3", "t", 1, 3), ("a", "b", "q", "c", "u", 1, 4)]
    got = {r["textbook_id"]: r for r in graph.merge_nodes(spark.createDataFrame(rows, NODE)).collect()}
    assert (got["t"]["frequency"], got["t"]["definition"], got["t"]["category"]) == (5, "yyy", "c1")
    merged = graph.merge_relations(relations).collect()
    assert len(merged) == 3 and next(r for r in merged if r["source"] == "n1")["confidence"] == 0.9


def test_relations_of_nodes(nodes, relations):
    merged = graph.merge_relations(relations)
    assert ids(graph.valid_relations(merged, nodes), "source") == ["n1", "n2"]
    assert ids(graph.page_relations(merged, nodes.where("id = 'n2'")), "source") == ["n1", "n2"]


def test_pages(nodes):
    assert ids(graph.page(nodes, 2, 3)) == ["n4"]
    row = graph.page(nodes, 1, 1, "核心概念").first()
    assert (row["id"], row["total"], row["total_pages"]) == ("n1", 2, 2)
    for bad in ((0, 10), (1, 0), (1, 1001)):
        with pytest.raises(ValueError):
            graph.page(nodes, *bad)
    assert ids(graph.search(nodes, "炎症")) == ["n1", "n3"]


def test_updates(spark, nodes, relations):
    changes = spark.createDataFrame([("n1", "new", None), ("missing", "x", "y")], "id string, definition string, category string")
    got = {r["id"]: r for r in graph.update(nodes, changes, ["id"]).collect()}
    assert (got["n1"]["definition"], got["n1"]["category"], got["n2"]["definition"]) == ("new", "核心概念", "d" * 18) and len(got) == 4
    keys = ["source", "target", "relation_type"]
    one = spark.createDataFrame([("n1", "n2", "prerequisite", 0.3)], "source string, target string, relation_type string, confidence double")
    assert sorted(r["confidence"] for r in graph.update(relations, one, keys).collect()) == [0.1, 0.3, 0.8, 1.0]  # the first match only


def test_decisions(spark, nodes, relations):
    pairs = spark.createDataFrame([("n1", "n3", 0.95), ("n2", "n4", 0.75), ("n1", "n4", 0.5), ("n1", "unknown", 0.99)], "node1_id string, node2_id string, confidence double")
    decisions = integrate.decide(pairs, nodes)
    got = {r["action"]: r for r in decisions.collect()}
    assert (got["merge"]["affected_nodes"], got["merge"]["result_node"]) == (["n1", "n3"], "n1")
    assert (got["keep"]["affected_nodes"], got["keep"]["result_node"]) == (["n4", "n2"], "n4")
    assert (got["remove"]["affected_nodes"], got["remove"]["result_node"]) == (["n4"], "n1")
    assert tuple(integrate.decision_counts(decisions).first()) == (3, 1, 1, 1)
    assert ids(integrate.apply_decisions(nodes, decisions)) == ["n1", "n2"]
    kept = integrate.apply_decisions(nodes, decisions)
    stats = integrate.compression_stats(nodes, relations, kept, graph.valid_relations(relations, kept)).first()
    assert (stats["original_total_chars"], stats["compressed_total_chars"], stats["compressed_relation_count"]) == (24 + 20 + 37 + 27, 44, 2)


def test_budget(spark, nodes):
    first_two = nodes.where("textbook_id = 'book_1'").withColumn("frequency", F.lit(1))
    assert ids(integrate.select_for_budget(first_two, 50)) == ["n1", "n2"]
    assert ids(integrate.select_for_budget(first_two, 22)) == []
    empty = integrate.compression_stats(nodes.limit(0), spark.createDataFrame([], RELATION), nodes.limit(0), spark.createDataFrame([], RELATION)).first()
    assert empty["compression_ratio"] == 0.0
    many = spark.createDataFrame([(str(i), "ab", "c" * (i % 5), "x", "t", i % 7, i) for i in range(500)], NODE)
    total, want = 0, []
    for i in sorted(range(500), key=lambda i: (-(i % 7), i)):
        total += 2 + i % 5
        if total > 400:
            break
        want.append(str(i))
    assert ids(integrate.select_for_budget(many, 400, rows_each=16)) == sorted(want)
    assert ids(integrate.optimize_compression(nodes, spark.createDataFrame([], RELATION), 1.0)[0]) == ["n1", "n2", "n3", "n4"]
