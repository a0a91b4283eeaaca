"""Steps that want a language model, as replaceable functions with deterministic offline defaults.

A provider maps prompts to answers, a list at a time.  It runs inside ``mapInArrow``, after every
filter, so only rows that need an answer pay for one; failures give the documented fall-backs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import fenced_json, flat_json, model_json, node_id
from inkmill.functions.vectors import normalise
from inkmill.operators import graph, parse

Provider = Callable[[list[str]], list[str | None]]
NOT_FOUND = "当前知识库中未找到相关信息"
NODES_DDL = "array<struct<name: string, definition: string, category: string>>"
RELATIONS_DDL = "array<struct<source: string, target: string, relation_type: string, description: string>>"


def with_retries(provider: Provider, attempts: int = 3, together: int = 16) -> Callable[[list[str]], list[tuple[str | None, str | None]]]:
    """(answer, error) of each prompt.  Prompts go to the provider ``together`` at a time; those of a list
    that fails, or is answered in another number, are asked one by one, ``attempts`` times each."""

    def alone(prompt: str) -> tuple[str | None, str | None]:
        error = None
        for _ in range(attempts):
            try:
                return provider([prompt])[0], None
            except Exception as e:  # a provider may fail in any way; the row then has the last error
                error = str(e) or type(e).__name__
        return None, error

    def ask(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        out: list[tuple[str | None, str | None]] = []
        for i in range(0, len(prompts), together):
            some = prompts[i : i + together]
            try:
                found = list(provider(some)) if len(some) > 1 else []
            except Exception:  # which prompt it was shows when they are asked alone
                found = []
            out += [(f, None) for f in found] if len(found) == len(some) else [alone(p) for p in some]
        return out

    return ask


#: Prompts that a task holds as text at a time, with their answers.
AT_ONCE = 256


def answers(prompts: DataFrame, provider: Provider, attempts: int = 3) -> DataFrame:
    """``prompts`` (with a column prompt) and their ``answer``, or null and the ``error``.  Of a batch ``AT_ONCE``
    prompts at a time become text; other columns pass through as they are."""
    ask = with_retries(provider, attempts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, AT_ONCE):
                own = batch.slice(begin, AT_ONCE)
                found = ask(own.column("prompt").to_pylist())
                told = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own.columns, *told], names=[*own.schema.names, "answer", "error"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInArrow(run, f"{ddl}, answer string, error string")


def dense_encoder(model: Callable[[list[str]], list[list[float]]], together: int = 64) -> Callable[[DataFrame], DataFrame]:
    """An encoder of texts (id, text) as (id, vector), of unit length, from a function that gives the
    vectors of a list of texts."""

    def encode(texts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                own = pdf["text"].fillna("").tolist()
                found = [list(map(float, v)) for i in range(0, len(own), together) for v in model(own[i : i + together])]
                yield pd.DataFrame({"id": pdf["id"], "vector": found})

        kind = dict(texts.dtypes)["id"]
        return texts.select("id", "text").mapInPandas(run, f"id {kind}, vector array<double>").select("id", normalise("vector").alias("vector"))

    return encode


def segment_answers(chapters: DataFrame, provider: Provider, most: int = 6000) -> DataFrame:
    """(textbook_id, chapter_id, title, page_start, segment, answer) of each segment of chapters
    (textbook_id, chapter_id, title, content, page_start)."""
    cut = chapters.select("textbook_id", "chapter_id", "title", "page_start", F.posexplode(parse.segments("content", most)).alias("segment", "prompt"))
    return answers(cut, provider).drop("prompt", "error")


def extract_graph(chapters: DataFrame, provider: Provider, most: int = 6000) -> tuple[DataFrame, DataFrame]:
    """Nodes and relations of chapters; both read the answers, so where a model is dear, store those
    (``segment_answers``) and read the graph from them (``graph_of_answers``)."""
    return graph_of_answers(segment_answers(chapters, provider, most))


def graph_of_answers(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and relations from the answers of segments, JSON with nodes and relations; a segment whose
    answer is not is skipped."""
    found = segments.withColumn("j", F.from_json(model_json("answer"), f"nodes {NODES_DDL}, relations {RELATIONS_DDL}")).where("j is not null")
    where = ["textbook_id", "chapter_id", "title", "page_start", "segment"]
    n = found.select(*where, F.posexplode("j.nodes").alias("i", "n")).where("n.name is not null")
    seq = F.struct("chapter_id", "segment", "i")
    nodes = n.select("textbook_id", "n.name", F.coalesce("n.definition", F.lit("")).alias("definition"), F.coalesce("n.category", F.lit("核心概念")).alias("category"), F.col("title").alias("chapter"), "chapter_id", F.col("page_start").alias("page"), F.lit(1).cast("long").alias("frequency"), F.xxhash64("chapter_id").alias("h"), seq.alias("order"))
    nodes = _in_order(nodes)
    r = found.select(*where, F.posexplode("j.relations").alias("i", "r"))
    relations = r.select(node_id("textbook_id", "r.source").alias("source"), node_id("textbook_id", "r.target").alias("target"), F.coalesce("r.relation_type", F.lit("parallel")).alias("relation_type"), F.coalesce("r.description", F.lit("")).alias("description"), F.lit(1.0).alias("confidence"), seq.alias("order"))
    relations = _in_order(relations)
    merged = graph.with_ids(graph.merge_nodes(nodes))
    return merged, graph.valid_relations(graph.merge_relations(relations), merged)


def _in_order(rows: DataFrame) -> DataFrame:
    """``seq`` from ``order``: chapter number, segment, position within bounded fields."""
    chapter = F.coalesce(F.regexp_extract("order.chapter_id", r"([0-9]+)$", 1).cast("long"), F.lit(0))
    return rows.withColumn("seq", chapter * (1 << 40) + F.col("order.segment") * (1 << 20) + F.col("order.i")).drop("order", "h")


def verify_pairs(pairs: DataFrame, provider: Provider) -> DataFrame:
    """Pairs (with a prompt) and is_equivalent, confidence, reason: fields that a valid answer lacks are
    false, 0.5 and that there is no reason; without a valid answer false, 0.0 and what went wrong."""
    found = answers(pairs, provider).withColumn("j", F.from_json(F.coalesce(flat_json("answer"), fenced_json("answer")), "is_equivalent boolean, confidence double, reason string"))
    failed = F.concat(F.lit("LLM验证失败: "), F.coalesce("error", F.lit("no valid JSON")))
    own = [c for c in pairs.columns if c not in ("is_equivalent", "confidence", "reason")]
    return found.select(*own, F.coalesce("j.is_equivalent", F.lit(False)).alias("is_equivalent"), F.when(F.col("j").isNull(), 0.0).otherwise(F.coalesce("j.confidence", F.lit(0.5))).alias("confidence"), F.when(F.col("j").isNull(), failed).otherwise(F.coalesce("j.reason", F.lit("无理由"))).alias("reason"))


def decision_reasons(decisions: DataFrame, provider: Provider) -> DataFrame:
    """Decisions (with action and prompt) and reason, reason_confidence; an answer without a
    reason says so, and the fall-back for no valid answer names the action."""
    found = answers(decisions, provider).withColumn("j", F.from_json(fenced_json("answer"), "reason string, confidence double"))
    return found.select(*decisions.columns, F.when(F.col("j").isNull(), F.concat(F.lit("基于规则判断: "), "action")).otherwise(F.coalesce("j.reason", F.lit("无理由"))).alias("reason"), F.coalesce("j.confidence", F.lit(0.5)).alias("reason_confidence"))


def answer_questions(questions: DataFrame, provider: Provider) -> DataFrame:
    """Questions (with context and prompt), ``answer`` and ``answered``: without context, that nothing was
    found; after a failure, the error's text.  Only real answers are ``answered``."""
    asked = answers(questions.where("context <> ''"), provider)
    text = F.coalesce("answer", F.concat(F.lit("生成答案时出错: "), F.coalesce("error", F.lit(""))))
    asked = asked.withColumns({"answer": text, "answered": F.col("answer").isNotNull()}).drop("error")
    return asked.unionByName(questions.where("context is null or context = ''").withColumns({"answer": F.lit(NOT_FOUND), "answered": F.lit(False)}))


def rule_provider(prompts: list[str]) -> list[str]:
    """The offline extraction: each distinct capitalised word of a segment is a node, neighbours relate."""
    import json
    import re

    out = []
    for prompt in prompts:
        names = list(dict.fromkeys(re.findall(r"\b[A-ZÀ-Þ]\w{3,}", prompt)))
        nodes = [{"name": n, "definition": "", "category": "核心概念"} for n in names]
        relations = [{"source": a, "target": b, "relation_type": "parallel", "description": ""} for a, b in zip(names, names[1:])]
        out.append(json.dumps({"nodes": nodes, "relations": relations}, ensure_ascii=False))
    return out
