"""Whole tasks over a store: books from files, their graphs, an index, answers, chat turns, integration.

Each is a chain of the library's operators that writes its result, so what a model said is asked for
once and read back.  Tasks record their state; one that fails records the error and raises it.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import hooks
from inkmill.functions.text import suggestions
from inkmill.operators import dialogue, embed, graph, index, integrate, parse, vector
from inkmill.sources import files, scratch
from inkmill.sources.store import Store

ANSWER = """你将得到若干教材片段和一个问题。只依据片段作答，引用之处写明[教材名称, 章节]；片段不足以作答时只写“{none}”。

片段：
{context}

问题：{question}"""
CHAT = """下面是一段对话的最近内容和刚收到的一条消息。请接着作答：说明所依据的整合决策，改动之前先请对方确认。

最近内容：
{history}

刚收到：{message}"""
EQUIVALENT = """以下两个知识点是否描述同一个概念？请以JSON返回 is_equivalent、confidence、reason。

1. {one}
2. {two}"""
REASON = """请说明对以下知识点执行{action}的理由，以JSON返回 reason、confidence。

1. {one}
2. {two}"""


def _filled(template: str, **fields: str | Column) -> Column:
    """A prompt: the template with each {field} replaced by a column; what columns hold is not looked at."""
    parts, rest = [], template
    while rest:
        text, _, rest = rest.partition("{")
        parts.append(F.lit(text))
        if rest:
            name, _, rest = rest.partition("}")
            parts.append(F.coalesce(F.col(fields[name]) if isinstance(fields[name], str) else fields[name], F.lit("")))
    return F.concat(*parts)


def _recorded(task: Callable):
    """Record a task's state in the store under ``task_id``, if one is given."""

    @functools.wraps(task)
    def run(store: Store, *args, task_id: str | None = None, **kwargs):
        if task_id is None:
            return task(store, *args, **kwargs)
        store.log_task(task_id, "set", status="processing", progress=0.0, error_message=None)
        try:
            result = task(store, *args, **kwargs)
        except Exception as e:
            store.log_task(task_id, "update", status="failed", progress=0.0, error_message=str(e))
            raise
        store.log_task(task_id, "update", status="completed", progress=100.0)
        return result

    return run


@_recorded
def parse_books(store: Store, path: str) -> DataFrame:
    """Parse all files at a path, keep their chapters under the files' ids, and return each file's status."""
    spark = store.chapters.spark
    file_id, _ = dialogue.file_of("filename")
    store.chapters.save(files.parse_files(spark, path).withColumn("file_id", file_id))
    return files.parse_status(spark, path)


def take_in(store: Store, path: str, checkpoint: str, name: str = "uploads") -> DataFrame:
    """Parse the files that are new at a path, as a stream, and return the status of all that were taken in so far.

    Each file is parsed once, and its content is kept only in its chapters: the stream's place is kept at ``checkpoint``, and a restart goes on after the last
    micro-batch.  A batch writes its files' chapters and their status, with each failed file's own error; both are
    replaced if the batch is run again, so a batch that failed half-way is made whole."""
    spark = store.chapters.spark
    file_id, _ = dialogue.file_of("filename")

    def step(rows: DataFrame, number: int) -> None:
        new = files.named(rows)
        chapters = scratch.written(files.chapters_of(new).withColumn("file_id", file_id))
        store.chapters.save(chapters)
        store.uploads.save(files.status_of(new, chapters).withColumns({"file_id": file_id, "batch": F.lit(f"{name}-{number}")}))
        scratch.discard(chapters)

    incoming = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    incoming.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return store.uploads.read()


@_recorded
def build_graph(store: Store, file_id: str, provider: hooks.Provider = hooks.rule_provider, most: int = 6000) -> None:
    """Extract the graph of a stored book and replace what is stored of it."""
    chapters = store.chapters.load(file_id)
    if not chapters.limit(1).count():
        raise ValueError(f"no chapters of {file_id}")
    store.answers.delete(file_id)
    store.answers.append(hooks.segment_answers(chapters, provider, most).withColumn("file_id", F.lit(file_id)))
    store.save_graph(file_id, *hooks.graph_of_answers(store.answers.load(file_id)))


def _encoder(store: Store, model: str, texts: DataFrame, encode: embed.Encoder | None) -> embed.Encoder:
    """The encoder of a model: as given, else TF-IDF with the stored vocabulary, fitted on ``texts`` if there is none."""
    if encode is not None:
        return encode
    known = store.vocabulary.load(model)
    if not known.limit(1).count():
        store.vocabulary.replace(model, embed.tfidf_fit(texts))
        known = store.vocabulary.load(model)
    return embed.tfidf_encoder(known.select("term", "idf"))


def vectors_of(store: Store, texts: DataFrame, model: str = "tfidf", encode: embed.Encoder | None = None) -> DataFrame:
    """``texts`` (id, text, ...) with ``vector``: what the cache lacks is encoded, written to it, and read back."""
    fresh = embed.fresh_vectors(texts, store.cache.read(), _encoder(store, model, texts, encode), model)
    store.cache.append(fresh)
    return embed.encode_cached(texts, store.cache.read(), fresh.limit(0), model)


@_recorded
def index_books(store: Store, file_ids: Sequence[str], index_name: str = "default", model: str = "tfidf", encode: embed.Encoder | None = None, size: int = 600, overlap: int = 100) -> int:
    """Chunk the stored books, embed the chunks through the cache, and replace the index; the number of chunks."""
    own = store.chapters.read().where(F.col("file_id").isin(*file_ids))
    own = own.withColumn("textbook_title", F.coalesce("textbook_title", "textbook_id"))
    chunks = parse.chunk_table(own, size, overlap).select(F.col("chunk_id").alias("id"), F.col("content").alias("text"), "textbook_id", "textbook_title", "chapter_title", "page_start", "content")
    if not chunks.limit(1).count():
        raise ValueError("No valid chunks generated")
    store.vectors.replace(index_name, vectors_of(store, chunks, model, encode).drop("text"))
    return store.vectors.load(index_name).count()


#: Books are dealt into this many parts of an index; a part is what compaction rewrites.
BUCKETS = 64


@_recorded
def update_index(store: Store, file_ids: Sequence[str], index_name: str = "default", model: str = "tfidf", encode: embed.Encoder | None = None, size: int = 600, overlap: int = 100, most_dead: float = 0.3) -> dict[str, int]:
    """Bring the index to what is stored of some books: only chunks whose content changed are embedded and written,
    those that went get tombstones, and books not named stay as they are.  A book without chapters leaves the
    index.  Returns how many chunks were written (``added``) and removed; ``compacted`` counts rewritten parts."""
    spark = store.chapters.spark
    books = spark.createDataFrame([(f,) for f in file_ids], "textbook_id string")
    own = store.chapters.read().where(F.col("file_id").isin(*file_ids)).withColumn("textbook_title", F.coalesce("textbook_title", "textbook_id"))
    # within an index a book goes by its file
    chunks = parse.chunk_table(own.withColumn("textbook_id", F.col("file_id")), size, overlap)
    keyed = index.keyed(chunks.select("textbook_id", F.col("chunk_id").cast("string").alias("chunk_id"), "textbook_title", "chapter_title", "page_start", "content"))
    log = store.chunk_log.load(index_name)
    version = (log.agg(F.max("version")).first()[0] or 0) + 1
    rows = scratch.settled(index.changes(log, keyed, books, version).join(keyed, [*index.ID, "key"], "left"))
    counts = rows.agg(F.count_if("live").alias("added"), F.count_if(~F.col("live")).alias("removed")).first().asDict()
    if any(counts.values()):
        new = rows.where("live").withColumn("text", F.col("content"))
        known = vectors_of(store, new, model, encode).drop("text") if counts["added"] else new.drop("text").withColumn("vector", F.lit(None).cast("array<double>"))
        whole = known.unionByName(rows.where("not live").withColumn("vector", F.lit(None).cast("array<double>")))
        store.chunk_log.append(whole.withColumns({"index_name": F.lit(index_name), "bucket": F.pmod(F.xxhash64("textbook_id"), F.lit(BUCKETS)).cast("int")}))
    return counts | {"compacted": store.compact(index_name, most_dead) if counts["removed"] or counts["added"] else 0}


def retrieve(store: Store, questions: DataFrame, k: int = 5, index_name: str = "default", model: str = "tfidf", encode: embed.Encoder | None = None) -> DataFrame:
    """(question_id, rank, similarity, chunk_id, textbook_title, chapter_title, page_start, content): the k nearest
    chunks of each question (question_id, question)."""
    asked = questions.select(F.col("question_id").alias("id"), F.coalesce("question", F.lit("")).alias("text"))
    queries = _encoder(store, model, asked, encode)(asked).select(F.col("id").alias("query_id"), "vector")
    own = store.index_rows(index_name)
    hits = vector.top_k_batch(own.select("id", "vector"), queries, k, skip_self=False)
    found = hits.join(own.select("id", "textbook_title", "chapter_title", "page_start", "content"), "id")
    return found.withColumnsRenamed({"query_id": "question_id", "id": "chunk_id"})


def with_context(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions with the context, citations and source_chunks of their hits, best first; without hits null and empty."""
    keyed = hits.withColumn("citation", F.struct(*dialogue.citation_fields()))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(c).alias("v")))), lambda x: x["v"])
    each = keyed.groupBy("question_id").agg(dialogue.rag_context().alias("context"), in_order("citation").alias("citations"), in_order("content").alias("source_chunks"))
    return questions.join(each, "question_id", "left")


def ask(store: Store, questions: DataFrame, provider: hooks.Provider, k: int = 5, index_name: str = "default", model: str = "tfidf", encode: embed.Encoder | None = None) -> DataFrame:
    """(question_id, question, answer, citations, source_chunks) of questions (question_id, question): retrieval,
    context, answer.  Without hits the answer says that nothing was found; after a failure it is the
    error's text; both have no citations."""
    own = questions.select("question_id", "question")
    asked = with_context(own, retrieve(store, own, k, index_name, model, encode))
    prompt = _filled(ANSWER, none=F.lit(hooks.NOT_FOUND), context="context", question="question")
    found = hooks.answer_questions(asked.withColumn("prompt", prompt), provider)
    keep = lambda c: F.when(F.col("answered"), F.col(c)).otherwise(F.array().cast(found.schema[c].dataType)).alias(c)
    return found.select("question_id", "question", "answer", keep("citations"), keep("source_chunks"))


def chat_batch(store: Store, turns: DataFrame, provider: hooks.Provider, batch: str, n: int = 10) -> DataFrame:
    """(conv_id, turn, response, suggestions) of users' new messages (conv_id, text), for each conversation one
    reply after its last message; a null conv_id begins a conversation.

    Messages and replies are written together under the batch's name, and what a batch of that name wrote before is
    replaced and not looked at: one that is run again, after whatever failed, leaves what it would have
    left at once.  Several messages of a conversation are taken in order of ``sent``, if there is such a column, and of text.
    Where the provider fails the response is null and the messages stay.  Blank messages are passed over."""
    new_id = F.concat(F.lit("conv_"), F.substring(F.md5(F.concat(F.lit(f"{batch}:"), "text")), 1, 8))
    sent = F.col("sent") if "sent" in turns.columns else F.lit(None)
    own = turns.where("trim(text) <> ''").select(F.coalesce(F.col("conv_id").cast("string"), new_id).alias("conv_id"), "text", sent.alias("sent"))
    before = store.messages.read().where(F.coalesce(F.col("batch") != batch, F.lit(True)))
    known = before.join(own.select("conv_id"), "conv_id", "left_semi")
    last = known.groupBy("conv_id").agg(F.max("turn").alias("last"))
    order = Window.partitionBy("conv_id").orderBy("sent", "text")
    asked = own.withColumn("__n", F.row_number().over(order)).join(last, "conv_id", "left")
    asked = scratch.settled(asked.select("conv_id", (F.coalesce("last", F.lit(-1)) + F.col("__n")).alias("turn"), F.lit("user").alias("role"), "text"))
    history = dialogue.transcript(known.select("conv_id", "turn", "role", "text").unionByName(asked), n)
    newest = asked.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))
    prompts = newest.join(history, "conv_id").withColumn("prompt", _filled(CHAT, history="history", message="text"))
    replies = hooks.answers(prompts, provider).where("answer is not null")
    said = replies.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    store.messages.put(batch, asked.unionByName(said).withColumn("written", F.current_timestamp().cast("timestamp_ntz")))
    written = store.messages.read().where((F.col("batch") == batch) & (F.col("role") == "assistant")).select("conv_id", F.col("text").alias("response"))
    return newest.join(written, "conv_id", "left").select("conv_id", "turn", "response", suggestions("text").alias("suggestions"))


def chat(store: Store, turns: DataFrame, provider: hooks.Provider, n: int = 10) -> DataFrame:
    """``chat_batch`` of messages (conv_id, text), one a conversation, as a batch of its own.  A blank message, or two of one
    conversation, are an error and nothing is added."""
    if turns.where("text is null or trim(text) = ''").limit(1).count():
        raise ValueError("Message cannot be empty")
    if turns.where("conv_id is not null").groupBy("conv_id").count().where("count > 1").limit(1).count():
        raise ValueError("one message a conversation")
    return chat_batch(store, turns, provider, f"chat-{uuid.uuid4().hex}", n)


def chat_stream(store: Store, turns: DataFrame, provider: hooks.Provider, checkpoint: str, name: str, n: int = 10) -> None:
    """Answer what is new in a stream of messages (conv_id, text, ...); each micro-batch is a batch of the stream's
    name and its number, so one that is retried adds nothing."""
    def step(rows: DataFrame, number: int) -> None:
        chat_batch(store, rows, provider, f"{name}-{number}", n)

    stream = turns.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()


def align(nodes: DataFrame, vectors: DataFrame, books: Sequence[str], threshold: float = 0.7, provider: hooks.Provider | None = None, ordered: bool = True) -> DataFrame:
    """Pairs of nodes (id, textbook_id, name, definition) of different books that may be the same, by the
    vectors (id, vector) of their texts: node1 is of the book that comes first in ``books``.  Without a
    provider pairs over the threshold are equivalent; with one it decides.  Best first within two books, unless
    not ``ordered``.  Names (with a provider definitions too) come along in the join of vectors: pairs may be very
    many, and are shuffled only to be ordered."""
    place = F.array_position(F.array(*map(F.lit, books)), F.col("textbook_id"))
    told = [F.col("name").alias("node_name"), *([F.col("definition")] if provider else [])]
    items = vectors.select("id", "vector").join(nodes.where(F.col("textbook_id").isin(*books)).select("id", place.cast("long").alias("book"), *told), "id")
    pairs = vector.similar_pairs(items, threshold)
    names = F.array(*map(F.lit, books))
    for i in ("1", "2"):
        pairs = pairs.withColumnsRenamed({f"id{i}": f"node{i}_id", f"book{i}": f"place{i}", f"node_name{i}": f"node{i}_name"}).withColumn(f"book{i}", F.element_at(names, F.col(f"place{i}").cast("int")))
    if provider is None:
        said = F.format_string("基于嵌入相似度: %.3f", "similarity")
        pairs = pairs.withColumns({"is_equivalent": F.lit(True), "confidence": F.col("similarity"), "reason": said})
    else:
        prompt = _filled(EQUIVALENT, one=node_text("node1_name", "definition1"), two=node_text("node2_name", "definition2"))
        pairs = hooks.verify_pairs(pairs.withColumn("prompt", prompt), provider)
    columns = ["node1_id", "node2_id", "node1_name", "node2_name", "book1", "book2", "similarity", "is_equivalent", "confidence", "reason"]
    if ordered:
        pairs = pairs.orderBy("place1", "place2", F.desc("similarity"), "node1_id", "node2_id")
    return pairs.select(*columns)


def node_text(name: str = "name", definition: str = "definition") -> Column:
    """The text by which a node is embedded and told to a model."""
    return F.concat(F.coalesce(name, F.lit("")), F.lit(": "), F.coalesce(definition, F.lit("")))


@_recorded
def integrate_books(store: Store, file_ids: Sequence[str], verify: hooks.Provider | None = None, reasons: hooks.Provider | None = None, threshold: float = 0.7, most: float = 0.3, to_budget: bool = False) -> dict[str, DataFrame]:
    """Align, decide, apply and report over the stored graphs of some files: pairs, summary, decisions, nodes,
    relations and statistics.  Nodes keep to the character budget only if asked (``to_budget``)."""
    chosen = F.col("file_id").isin(*file_ids)
    nodes = store.nodes.read().where(chosen).withColumn("textbook_id", F.col("file_id"))
    relations = store.relations.read().where(chosen)
    if not nodes.limit(1).count():
        raise ValueError("No valid knowledge graphs found")
    vectors = vectors_of(store, nodes.select("id", node_text().alias("text")))
    # what a model says of a pair is asked for once: pairs and decisions are read several times
    pairs = align(nodes, vectors, file_ids, threshold, verify).persist()
    decisions = integrate.decide(pairs.where("is_equivalent").select("node1_id", "node2_id", "confidence"), nodes)
    known = nodes.select("id", node_text().alias("t"))
    for i, field in (("1", "one"), ("2", "two")):
        decisions = decisions.join(known.withColumnsRenamed({"id": f"node{i}_id", "t": field}), f"node{i}_id")
    if reasons is None:
        said = {"reason": F.concat(F.lit("基于规则判断: "), "action"), "reason_confidence": F.lit(0.5)}
        decisions = decisions.withColumns(said)
    else:
        decisions = hooks.decision_reasons(decisions.withColumn("prompt", _filled(REASON, action="action", one="one", two="two")), reasons)
    decisions = decisions.select("decision_id", "node1_id", "node2_id", "action", "affected_nodes", "result_node", "reason", F.col("reason_confidence").alias("confidence")).persist()
    kept = integrate.apply_decisions(nodes, decisions)
    links = graph.valid_relations(relations, kept)
    if to_budget:
        kept, links = integrate.optimize_compression(kept, links, most)
    stats = integrate.compression_stats(nodes, relations, kept, links, most)
    spark = nodes.sparkSession
    books = spark.createDataFrame([(f, i) for i, f in enumerate(file_ids)], "book string, place int")
    return {"pairs": pairs, "summary": integrate.align_summary(pairs, books), "decisions": decisions, "nodes": kept, "relations": links, "statistics": integrate.report(books, decisions, stats)}
