"""Whole tasks over a store, with providers that answer, refuse and fail."""

import pytest
from pyspark.sql import functions as F

from inkmill import workflows
from inkmill.functions import hooks
from inkmill.operators import dialogue, embed, integrate, vector
from inkmill.sources.store import Store
from inkmill.sources.scratch import shared_folder

QUESTIONS = "question_id string, question string"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    (folder / "f1_one.txt").write_text("第一章 Cells\nCells contain water and salt.\n第二章 Atoms\nAtoms contain electrons.\n", encoding="utf-8")
    (folder / "f2_two.md").write_text("# T\n## Stars\nStars contain hydrogen. Cells contain water and salt.\n", encoding="utf-8")
    out = Store(spark, str(tmp_path_factory.mktemp("store")))
    status = workflows.parse_books(out, str(folder), task_id="parse")
    assert {r["parse_status"] for r in status.collect()} == {"completed"}
    return out


def test_books_and_graphs(store):
    assert {(r["file_id"], r["chapter_count"], r["progress"]) for r in store.parse_status().collect()} == {("f1", 2, 100.0), ("f2", 1, 100.0)}
    for f in ("f1", "f2"):
        workflows.build_graph(store, f, task_id=f"graph {f}")
    assert {r["file_id"] for r in store.extraction_status().collect()} == {"f1", "f2"}
    row = store.graphs.load("f1").first()
    assert row["extracted_at"] is not None and row["total_nodes"] == store.nodes.load("f1").count() == 2
    with pytest.raises(ValueError):
        workflows.build_graph(store, "none", task_id="graph none")
    tasks = {r["task_id"]: r["fields"] for r in store.task_fields().collect()}
    assert tasks["graph f1"]["status"] == "completed" and tasks["graph none"]["status"] == "failed" and "none" in tasks["graph none"]["error_message"]


def test_index_and_ask(spark, store):
    n = workflows.index_books(store, ["f1", "f2"], task_id="index")
    assert n == 3 and store.cache.read().count() == 3
    assert workflows.index_books(store, ["f1", "f2"]) == 3 and store.cache.read().count() == 3  # all from the cache
    with pytest.raises(ValueError, match="No valid chunks"):
        workflows.index_books(store, ["none"])

    def provider(prompts):
        if any("fails" in p for p in prompts):
            raise RuntimeError("no service")
        return [f"seen {p.count('[来源: ')}" for p in prompts]

    asked = spark.createDataFrame([("q1", "electrons of atoms"), ("q2", "what fails")], QUESTIONS)
    got = {r["question_id"]: r for r in workflows.ask(store, asked, provider, k=2).collect()}
    assert got["q1"]["answer"] == "seen 2" and got["q1"]["citations"][0]["chapter"] == "第二章 Atoms" and "electrons" in got["q1"]["source_chunks"][0]
    assert got["q1"]["citations"][0]["relevance_score"] > got["q1"]["citations"][1]["relevance_score"]
    assert got["q2"]["answer"] == "生成答案时出错: no service" and got["q2"]["citations"] == [] and got["q2"]["source_chunks"] == []
    none = workflows.ask(store, asked, provider, index_name="empty").collect()
    assert {r["answer"] for r in none} == {hooks.NOT_FOUND} and {len(r["citations"]) for r in none} == {0}


def test_chat(spark, store):
    def provider(prompts):
        if any("坏" in p for p in prompts):
            raise RuntimeError
        return [str(p.count("用户: ")) for p in prompts]

    first = {r["conv_id"]: r for r in workflows.chat(store, spark.createDataFrame([("a", "整合 x"), ("b", "坏"), (None, "hello")], "conv_id string, text string"), provider).collect()}
    fresh = [c for c in first if c.startswith("conv_")]
    assert first["a"]["response"] == "1" and first["a"]["suggestions"] == ["查看所有整合决策", "修改这个决策"] and first["b"]["response"] is None and len(fresh) == 1
    second = workflows.chat(store, spark.createDataFrame([("a", "again")], "conv_id string, text string"), provider).first()
    assert (second["turn"], second["response"]) == (2, "2")
    assert [(r["turn"], r["role"]) for r in store.history("a").collect()] == [(0, "user"), (1, "assistant"), (2, "user"), (3, "assistant")]
    assert [r["role"] for r in store.history("b").collect()] == ["user"]
    for bad in ([("a", " ")], [("a", "x"), ("a", "y")]):
        with pytest.raises(ValueError):
            workflows.chat(store, spark.createDataFrame(bad, "conv_id string, text string"), provider)


def test_alignment_order_and_verification(spark):
    nodes = spark.createDataFrame([("x", "B", "n1", "d"), ("y", "A", "n2", "d"), ("z", "A", "n3", "d")], "id string, textbook_id string, name string, definition string")
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [1.0, 0.2]), ("z", [1.0, 0.0])], "id string, vector array<double>")
    got = workflows.align(nodes, vectors, ["B", "A"]).collect()
    assert [(r["node1_id"], r["node2_id"], r["is_equivalent"]) for r in got] == [("x", "z", True), ("x", "y", True)] and got[0]["reason"] == "基于嵌入相似度: 1.000"
    provider = lambda prompts: ['{"is_equivalent": true}' if "n3" in p else "?" for p in prompts]
    pairs = workflows.align(nodes, vectors, ["A", "B"], provider=provider)
    assert [(r["node1_id"], r["is_equivalent"], r["confidence"], r["reason"]) for r in pairs.collect()] == [("z", True, 0.5, "无理由"), ("y", False, 0.0, "LLM验证失败: no valid JSON")]
    books = spark.createDataFrame([("A", 0), ("C", 1), ("B", 2)], "book string, place int")
    summary = {(r["book1"], r["book2"]): (r["total_pairs_checked"], r["equivalent_count"]) for r in integrate.align_summary(pairs, books).collect()}
    assert summary == {("A", "B"): (2, 1), ("A", "C"): (0, 0), ("C", "B"): (0, 0)}


def test_integration(store):
    for f in ("f1", "f2"):
        workflows.build_graph(store, f)
    got = workflows.integrate_books(store, ["f1", "f2"], reasons=lambda prompts: ['{"reason": "same", "confidence": 0.8}'] * len(prompts), task_id="merge")
    assert [(r["action"], r["reason"], r["confidence"]) for r in got["decisions"].collect()] == [("merge", "same", 0.8)]
    stats = got["statistics"].first()
    assert (stats["original_textbook_count"], stats["merge_count"], stats["compressed_node_count"]) == (2, 1, stats["original_node_count"] - 1)
    kept = {r["id"] for r in got["nodes"].collect()}
    assert all(r["source"] in kept and r["target"] in kept for r in got["relations"].collect())


def test_states_and_vectors(spark, store):
    log = spark.createDataFrame([("t", 1, "set", '{"a": 1, "b": "x"}'), ("t", 2, "update", '{"b": "y", "c": null}'), ("t", 3, "update", '{"d": 2.5}'), ("u", 1, "update", '{"a": 1}'), ("u", 2, "set", '{"b": 2}'), ("v", 1, None, "{}")], "task_id string, seq long, kind string, state string")
    got = {r["task_id"]: r["fields"] for r in dialogue.merged_fields(log).collect()}
    assert got == {"t": {"a": "1", "b": "y", "c": None, "d": "2.5"}, "u": {"b": "2"}, "v": {}}
    rows = spark.createDataFrame([("i1", [1.0, 2.0])], "id string, vector array<double>")
    store.append_vectors("plain", rows)
    store.append_vectors("plain", rows)
    assert store.vectors.load("plain").count() == 2
    for bad in ([1.0], None):
        with pytest.raises(ValueError, match="unequal"):
            store.append_vectors("plain", spark.createDataFrame([("i2", bad)], "id string, vector array<double>"))


def test_lists_of_prompts(spark):
    seen = []

    def provider(prompts):
        seen.append(len(prompts))
        if "x" in prompts:
            raise RuntimeError("x")
        return [p.upper() for p in prompts]

    assert hooks.with_retries(provider, 2, 3)(["a", "b", "c", "d", "x"]) == [("A", None), ("B", None), ("C", None), ("D", None), (None, "x")]
    assert seen == [3, 2, 1, 1, 1]
    assert hooks.with_retries(lambda prompts: [], 2)(["a"])[0][0] is None


def test_dense_encoder_and_file_names(spark):
    texts = spark.createDataFrame([("k", "abc"), ("l", None), ("m", "abc")], "id string, text string")
    encode = hooks.dense_encoder(lambda own: [[float(len(t)), 4.0] for t in own])
    assert {r["id"]: r["vector"] for r in encode(texts).collect()} == {"k": [0.6, 0.8], "l": [0.0, 1.0], "m": [0.6, 0.8]}
    cache = spark.createDataFrame([], "model string, key string, vector array<double>")
    fresh = embed.fresh_vectors(texts.where("text is not null"), cache, encode, "dense")
    assert fresh.count() == 1
    got = embed.encode_cached(texts.where("text is not null"), cache, fresh, "dense").collect()
    assert {r["id"]: r["vector"] for r in got} == {"k": [0.6, 0.8], "m": [0.6, 0.8]}
    names = spark.createDataFrame([("7_a_b.txt",), ("plain.txt",)], "name string")
    assert [tuple(r) for r in names.select(*dialogue.file_of("name")).collect()] == [("7", "a_b.txt"), ("plain.txt", "plain.txt")]


def test_search_by_text_ids(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1])], "id string, vector array<double>")
    q = v.withColumnRenamed("id", "query_id")
    assert {(r["query_id"], r["id"]) for r in vector.top_k_batch(v, q, 1).collect()} == {("a", "b"), ("b", "a")}
    assert {(r["query_id"], r["id"]) for r in vector.top_k_batch(v, q, 1, skip_self=False).collect()} == {("a", "a"), ("b", "b")}


def test_empty_conversations_and_shared_folder(spark):
    messages = spark.createDataFrame([("a", 0, "user", "x")], "conv_id string, turn long, role string, text string")
    asked = spark.createDataFrame([("a",), ("b",), ("b",)], "conv_id string")
    assert {r["conv_id"]: r["summary"] for r in dialogue.summaries(messages, asked=asked).collect()} == {"a": "最近对话：\n用户: x...\n", "b": dialogue.NO_HISTORY}
    assert shared_folder(spark) and messages.agg(F.count("*")).first()[0] == 1
