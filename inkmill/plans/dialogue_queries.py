"""Queries on conversations, task logs and file listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.functions.text import suggestions as suggest
from inkmill.operators import dialogue
from inkmill.plans.tables import read
from inkmill.streaming import messages
from inkmill.streaming.conversations import conversation_state, run_available

QUERIES, ORACLE = {}, {}
#: The supplied conversations are invented prose; these words stand for the topics.
TOPICS = ("queau", "thion", "with", "pour", "that")
_RULES = ((("the", "que"), ("A1", "A2")), (("with",), ("B1", "B2")))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def recent_messages(spark, d):
    return dialogue.recent(read(spark, d, "conversations"), 3)


_TOPIC = "CASE " + " ".join(f"WHEN contains(text, '{t}') THEN '{t}'" for t in TOPICS) + " END"


@query(f"SELECT conv_id, turn, last_value({_TOPIC} IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS current_topic FROM conversations")
def sticky_topic(spark, d):
    return dialogue.sticky_topic(read(spark, d, "conversations"), TOPICS).select("conv_id", "turn", "current_topic")


@query("SELECT conv_id, '最近对话：' || chr(10) || string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || left(text, 50) || '...' || chr(10), '' ORDER BY turn) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5 GROUP BY conv_id")
def context_summary(spark, d):
    return dialogue.summaries(read(spark, d, "conversations"))


@query("SELECT conv_id, turn, CASE WHEN a AND b THEN 'A1,A2,B1' WHEN a THEN 'A1,A2' WHEN b THEN 'B1,B2' ELSE '查看整合统计,开始新的整合' END AS suggestions FROM (SELECT *, contains(text, 'the') OR contains(text, 'que') AS a, contains(text, 'with') AS b FROM conversations)")
def suggestions(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(suggest("text", _RULES), ",").alias("suggestions"))


@query("SELECT user_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def task_latest(spark, d):
    return dialogue.latest(read(spark, d, "events").select("user_id", F.col("event_type").alias("status"), "event_id", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("""SELECT d.doc_id AS file_id, source || '_' || d.doc_id AS name, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN quality = 1 THEN 'completed' ELSE 'failed' END WHEN b.item_id IS NOT NULL THEN 'completed' ELSE 'pending' END AS parse_status,
    coalesce(toxic, 0)::bigint AS chapter_count FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def file_listing(spark, d):
    files = read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("name"))
    status = read(spark, d, "labels").select(F.col("doc_id").alias("file_id"), F.expr("if(quality = 1, 'completed', 'failed')").alias("status"), F.col("toxic").cast("long").alias("chapter_count"))
    return dialogue.file_listing(files, status, read(spark, d, "benchmark").select(F.col("item_id").alias("file_id")))


@query("SELECT conv_id, turn, role FROM conversations c WHERE turn > coalesce((SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = 'system'), -1)")
def live_messages(spark, d):
    """A system message stands for a clearing of what precedes it."""
    messages = read(spark, d, "conversations")
    return dialogue.live(messages, messages.where("role = 'system'")).select("conv_id", "turn", "role")


_STATE = f"SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, arg_max({_TOPIC}, turn) FILTER ({_TOPIC} IS NOT NULL) AS current_topic FROM conversations GROUP BY conv_id"


@query(_STATE)
def conversation_batch(spark, d):
    return conversation_state(read(spark, d, "conversations"), TOPICS)


@query(_STATE)
def conversation_stream(spark, d):
    """The same state kept by a streaming query over the files that are there."""
    return run_available(spark, f"{d}/conversations.parquet", TOPICS)


_NAMED = "CASE " + " ".join(f"WHEN contains(text, '{t}') THEN '{t}'" for t in TOPICS) + " END"


@query(f"""SELECT conv_id, turn, last_value({_NAMED} IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS current_topic,
md5(string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS history FROM conversations""")
def message_stream(spark, d):
    """Each message of a stream with the topic and the last ten messages as its state tells them."""
    found = messages.run_available(spark, f"{d}/conversations.parquet", topics=TOPICS)
    return found.select("conv_id", "turn", "current_topic", F.md5(F.col("history").cast("binary")).alias("history"))
