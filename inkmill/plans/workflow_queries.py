"""Queries on the parts of whole tasks: question contexts, verification, histories, task states, uploads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkmill import workflows
from inkmill.functions import hooks
from inkmill.operators import dialogue, embed, integrate, vector
from inkmill.plans.tables import NODES_SQL, nodes, read
from inkmill.sources import files, scratch
from inkmill.sources.store import Store

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- questions and their contexts: every fiftieth vector asks, documents of the same number are the chunks


@query("""WITH h AS (SELECT * FROM (SELECT q.vec_id AS question_id, v.vec_id AS id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::double[], v.embedding::double[]) DESC, v.vec_id) AS rank FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 5)
SELECT question_id, md5(string_agg('[来源: ' || source || ', ' || lang || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context, count(*) AS sources, string_agg(left(text, 200), '|' ORDER BY rank) AS cited FROM h JOIN documents ON doc_id = id GROUP BY question_id""")
def question_context(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = v.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    hits = vector.top_k_batch(v, asked, 5, skip_self=False).withColumnsRenamed({"query_id": "question_id", "id": "chunk_id"})
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("textbook_title"), F.col("lang").alias("chapter_title"), F.lit(0).alias("page_start"), F.col("text").alias("content"))
    found = workflows.with_context(asked.select(F.col("query_id").alias("question_id")), hits.join(docs, "chunk_id"))
    return found.select("question_id", F.md5("context").alias("context"), F.size("source_chunks").cast("long").alias("sources"), F.array_join(F.transform("citations", lambda c: c["content"]), "|").alias("cited"))


# --- alignment in the order of books as given, here the greatest label first

_ALIGNED = "p AS (SELECT a.vec_id AS id1, b.vec_id AS id2, a.label::varchar AS book1, b.label::varchar AS book2, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS similarity FROM embeddings a JOIN embeddings b ON a.label > b.label)"


def _aligned(spark, d, ordered=True):
    own = read(spark, d, "embeddings")
    books = [r["label"] for r in own.select("label").distinct().orderBy(F.desc("label")).collect()]
    points = own.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("textbook_id"), F.lit("").alias("name"), F.lit("").alias("definition"))
    vectors = own.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return workflows.align(points, vectors, [str(b) for b in books], 0.3, ordered=ordered), books


@query(f"WITH {_ALIGNED} SELECT id1 AS node1_id, id2 AS node2_id, book1, book2, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.3")
def align_in_order(spark, d):
    return _aligned(spark, d)[0].select("node1_id", "node2_id", "book1", "book2", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_ALIGNED}, b AS (SELECT DISTINCT label AS l, label::varchar AS book FROM embeddings UNION ALL SELECT (SELECT min(label) FROM embeddings) - 1, 'none')
SELECT x.book AS book1, y.book AS book2, count(similarity) AS total_pairs_checked, count(*) FILTER (similarity >= 0.5) AS equivalent_count, round(coalesce(avg(similarity) FILTER (similarity >= 0.5), 0), 6) AS avg_similarity
FROM b x JOIN b y ON x.l > y.l LEFT JOIN (SELECT * FROM p WHERE similarity >= 0.3) p ON p.book1 = x.book AND p.book2 = y.book GROUP BY ALL""")
def align_summary_books(spark, d):
    """Candidates over 0.3, equivalent over 0.5, and a book without nodes."""
    pairs, books = _aligned(spark, d, ordered=False)
    placed = spark.createDataFrame([(str(b), i) for i, b in enumerate([*books, "none"])], "book string, place int")
    verified = pairs.withColumn("is_equivalent", F.col("similarity") >= 0.5)
    return integrate.align_summary(verified, placed).withColumn("avg_similarity", F.round("avg_similarity", 6))


@query(f"WITH {NODES_SQL} SELECT id, name || ': ' || definition AS text FROM nodes")
def node_texts(spark, d):
    return nodes(spark, d).select("id", workflows.node_text().alias("text"))


# --- answers of a model: here the prompt is the answer

_SAID = """CASE doc_id % 4 WHEN 0 THEN 'so: {"is_equivalent": true, "confidence": 0.9, "reason": "r"} as said' WHEN 1 THEN '```json' || chr(10) || '{"reason": "r"}' || chr(10) || '```' WHEN 2 THEN 'no idea' ELSE '{"is_equivalent": true}' END"""


def _said(spark, d):
    return read(spark, d, "documents").select("doc_id", F.lit("keep").alias("action"), F.expr(_SAID.replace("chr(10)", "'\\n'")).alias("prompt"))


def _echo(prompts: list[str]) -> list[str]:
    return prompts


@query("SELECT doc_id, doc_id % 4 IN (0, 3) AS is_equivalent, CASE doc_id % 4 WHEN 0 THEN 0.9::double WHEN 2 THEN 0::double ELSE 0.5::double END AS confidence, CASE doc_id % 4 WHEN 2 THEN 'LLM验证失败: no valid JSON' WHEN 3 THEN '无理由' ELSE 'r' END AS reason FROM documents")
def verified_pairs(spark, d):
    return hooks.verify_pairs(_said(spark, d), _echo).select("doc_id", "is_equivalent", "confidence", "reason")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'r' WHEN 3 THEN '无理由' ELSE '基于规则判断: keep' END AS reason, 0.5::double AS reason_confidence FROM documents")
def decision_reasons(spark, d):
    return hooks.decision_reasons(_said(spark, d), _echo).select("doc_id", "reason", "reason_confidence")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) THEN text ELSE '当前知识库中未找到相关信息' END AS answer, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) AS answered FROM documents")
def answered_questions(spark, d):
    """Documents with a label 0 have a context; the prompt is the answer."""
    found = read(spark, d, "labels").where("toxic = 0").select("doc_id", F.lit("context").alias("context"))
    asked = read(spark, d, "documents").select("doc_id", F.col("text").alias("prompt")).join(found, "doc_id", "left")
    return hooks.answer_questions(asked, _echo).select("doc_id", "answer", "answered")


# --- embeddings through a cache: a text's vector is its length, the cache has -1 for labelled texts


@query("SELECT doc_id, CASE WHEN md5(text) IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id)) THEN -1 ELSE length(text) END::double AS x FROM documents")
def encode_with_cache(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    held = docs.join(read(spark, d, "labels").select("doc_id"), "doc_id").select(F.lit("length").alias("model"), F.md5(F.col("text").cast("binary")).alias("key"), F.expr("array(-1D)").alias("vector"))
    length = lambda texts: texts.select("id", F.array(F.length("text").cast("double")).alias("vector"))
    fresh = embed.fresh_vectors(docs, held, length, "length")
    return embed.encode_cached(docs, held, fresh, "length").select("doc_id", F.col("vector")[0].alias("x"))


# --- conversations, tasks, files

_LINE = "CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || "


@query(f"SELECT conv_id, string_agg({_LINE}text, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 10 GROUP BY conv_id")
def chat_transcript(spark, d):
    return dialogue.transcript(read(spark, d, "conversations"))


@query(f"""WITH s AS (SELECT conv_id, '最近对话：' || chr(10) || string_agg({_LINE}left(text, 50) || '...' || chr(10), '' ORDER BY turn) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5 GROUP BY conv_id)
SELECT item_id AS conv_id, coalesce(summary, '无对话历史') AS summary FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN s ON conv_id = item_id""")
def context_summary_asked(spark, d):
    """Summaries of the conversations that have a benchmark item's number, had or not."""
    return dialogue.summaries(read(spark, d, "conversations"), asked=read(spark, d, "benchmark").select(F.col("item_id").alias("conv_id")))


@query("SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn + 1000, 'user', '[反馈] ' || text FROM conversations WHERE role = 'assistant' AND turn = 1")
def feedback_messages(spark, d):
    messages = read(spark, d, "conversations")
    return dialogue.feedback(messages, messages.where("role = 'assistant' and turn = 1").select("conv_id", (F.col("turn") + 1000).alias("turn"), "text"))


@query("""WITH s AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS f FROM events GROUP BY user_id)
SELECT user_id, event_type AS field, max(event_id)::varchar AS value FROM events JOIN s USING (user_id) WHERE f IS NULL OR event_id >= f GROUP BY user_id, event_type""")
def task_fields(spark, d):
    """Events as states of their users: an error replaces the state, others update one field."""
    log = read(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.expr("if(event_type = 'error', 'set', 'update')").alias("kind"), F.to_json(F.create_map("event_type", "event_id")).alias("state"))
    return dialogue.merged_fields(log, "user_id").select("user_id", F.explode("fields").alias("field", "value"))


@query("SELECT doc_id, split_part(name, '_', 1) AS file_id, CASE WHEN contains(name, '_') THEN substr(name, instr(name, '_') + 1) ELSE name END AS original FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE doc_id || '_' || source || '_' || lang END AS name FROM documents)")
def file_names(spark, d):
    file_id, original = dialogue.file_of("name")
    named = read(spark, d, "documents").select("doc_id", F.expr("if(doc_id % 3 = 0, source, concat_ws('_', doc_id, source, lang))").alias("name"))
    return named.select("doc_id", file_id.alias("file_id"), original.alias("original"))


_NAMED = "element_at(array('a.TXT', 'b.md', 'c.docx', 'd.xlsx', 'e.exe', 'none'), cast(doc_id % 6 as int) + 1)"


@query("""SELECT doc_id, doc_id % 6 < 4 AND n_chars * 200000 <= 209715200 AS accepted, CASE WHEN doc_id % 6 >= 4 THEN 'unsupported format' WHEN n_chars * 200000 > 209715200 THEN 'too large' END AS reason FROM documents""")
def upload_check(spark, d):
    own = read(spark, d, "documents").select("doc_id", F.expr(_NAMED).alias("filename"), (F.col("n_chars") * 200000).alias("size"))
    return files.upload_check(own).select("doc_id", "accepted", "reason")


# --- chat turns: benchmark items are new messages of the conversations of their number, had or not

_FRAME = len(workflows.CHAT.replace("{history}", "").replace("{message}", ""))


@query(f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT item_id, coalesce(m + 1, 0), 'user', text FROM benchmark LEFT JOIN (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id) ON conv_id = item_id),
h AS (SELECT conv_id, max(turn) AS turn, string_agg({_LINE}text, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM c) WHERE r <= 10 GROUP BY conv_id)
SELECT item_id::varchar AS conv_id, turn, 'user' AS role, md5(text) AS text FROM benchmark JOIN h ON conv_id = item_id
UNION ALL SELECT item_id::varchar, turn + 1, 'assistant', md5(({_FRAME} + length(history) + length(text))::varchar) FROM benchmark JOIN h ON conv_id = item_id""")
def chat_turns(spark, d):
    """What a batch of turns adds, run twice; the model's answer is the length of its prompt."""
    store = Store(spark, f"{scratch.shared_folder(spark)}/chat-{uuid.uuid4().hex}")
    store.messages.put("before", read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text"))
    turns = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("conv_id"), "text")
    for _ in range(2):  # the second time as a retry
        workflows.chat_batch(store, turns, lambda prompts: [str(len(p)) for p in prompts], "new")
    added = store.messages.read().where("batch = 'new'")
    return added.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text"))


@query("SELECT 'source=' || source AS book, 'completed' AS parse_status, 1::bigint AS chapter_count, (sum(length(text)) + count(*) - 1)::bigint AS total_chars FROM documents GROUP BY source")
def files_taken_in(spark, d):
    """Documents written out as a text file for each source, and taken in as a stream of files."""
    folder = f"{scratch.shared_folder(spark)}/files-{uuid.uuid4().hex}"
    docs = read(spark, d, "documents").select("source", "doc_id", "text")
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(f"{folder}/in")
    found = workflows.take_in(Store(spark, f"{folder}/store"), f"{folder}/in/*/*.txt", f"{folder}/place")
    return found.select(F.element_at(F.split("path", "/"), -2).alias("book"), "parse_status", "chapter_count", "total_chars")
