"""Dialogue logs (conv_id, turn, role, text): recent messages, topic, summaries; retrieval context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.operators.windows import running_last

#: Topic keywords, first match wins (fixed values).
TOPICS = ("整合", "决策", "知识点", "合并", "删除", "保留")
#: The summary of an empty conversation (fixed value).
NO_HISTORY = "无对话历史"


def recent(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n messages of each conversation; ranks are limited before the shuffle."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def topic_of(text: str, topics=TOPICS) -> Column:
    return F.coalesce(*[F.when(F.contains(F.col(text), F.lit(t)), F.lit(t)) for t in topics])


def sticky_topic(messages: DataFrame, topics=TOPICS, bucket_turns: int = 1024) -> DataFrame:
    """Messages with ``current_topic``: the last topic named so far."""
    marked = messages.withColumns({"__topic": topic_of("text", topics), "__bucket": F.floor(F.col("turn") / bucket_turns)})
    return running_last(marked, ["conv_id"], "__bucket", "turn", "__topic", "current_topic").drop("__topic", "__bucket")


#: What a message is led by, by its role (fixed values).
ROLES = {"user": "用户", "assistant": "助手"}


def role_label() -> Column:
    return F.when(F.col("role") == "user", ROLES["user"]).otherwise(ROLES["assistant"])


def transcript(messages: DataFrame, n: int = 10) -> DataFrame:
    """(conv_id, history): the last n messages, one a line, each led by its role."""
    last = recent(messages, n).withColumn("line", F.concat(role_label(), F.lit(": "), "text"))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda m: m["line"]), "\n").alias("history"))


def summaries(messages: DataFrame, n: int = 5, width: int = 50, asked: DataFrame | None = None) -> DataFrame:
    """(conv_id, summary) of the last n messages, in order, each cut to ``width`` characters.  With
    ``asked`` (conv_id) just of those conversations, and that there is no history where there is none."""
    if asked is not None:
        asked = asked.select("conv_id").distinct()
        found = summaries(messages.join(asked, "conv_id", "left_semi"), n, width)
        return asked.join(found, "conv_id", "left").withColumn("summary", F.coalesce("summary", F.lit(NO_HISTORY)))
    line = F.concat(role_label(), F.lit(": "), F.left("text", F.lit(width)), F.lit("...\n"))
    last = recent(messages, n).withColumn("line", line)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda m: m["line"]), "")
    return last.groupBy("conv_id").agg(F.concat(F.lit("最近对话：\n"), lines).alias("summary"))


def live(messages: DataFrame, cleared: DataFrame) -> DataFrame:
    """Messages after the last clearing (conv_id, turn) of their conversation."""
    last = cleared.groupBy("conv_id").agg(F.max("turn").alias("__cleared"))
    return messages.join(last, "conv_id", "left").where("__cleared is null or turn > __cleared").drop("__cleared")


def feedback(messages: DataFrame, notes: DataFrame) -> DataFrame:
    """Messages with feedback (conv_id, turn, text) added as messages of the user."""
    added = notes.select("conv_id", "turn", F.lit("user").alias("role"), F.concat(F.lit("[反馈] "), "text").alias("text"))
    return messages.select("conv_id", "turn", "role", "text").unionByName(added)


def rag_context() -> Column:
    """Aggregate: retrieved chunks (rank, textbook_title, chapter_title, content) as one context text."""
    part = F.concat(F.lit("[来源: "), F.coalesce("textbook_title", F.lit("")), F.lit(", "), F.coalesce("chapter_title", F.lit("")), F.lit("]\n"), F.coalesce("content", F.lit("")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank"), part.alias("part")))), lambda p: p["part"]), "\n\n")


def citation_fields(width: int = 200) -> list[Column]:
    """What a citation says of a retrieved chunk."""
    text = {"textbook": "textbook_title", "chapter": "chapter_title"}
    return [F.col("chunk_id"), *[F.coalesce(c, F.lit("")).alias(n) for n, c in text.items()], F.coalesce("page_start", F.lit(0)).alias("page"), F.left(F.coalesce("content", F.lit("")), F.lit(width)).alias("content"), F.col("similarity").alias("relevance_score")]


def citations(hits: DataFrame, width: int = 200) -> DataFrame:
    return hits.select(*citation_fields(width))


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: partial maxima, so a busy key is no single task."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(key, "__row.*")


def merged_fields(log: DataFrame, key: str = "task_id") -> DataFrame:
    """(key, fields) from a log (key, seq, kind, state as a JSON object): the last whole document (kind
    set, or null), with the fields of later updates laid over it one by one.  Values are JSON texts,
    strings bare; a document has few fields, so each key's map is small."""
    start = log.where("kind is null or kind = 'set'").groupBy(key).agg(F.max("seq").alias("__from"))
    valid = log.join(start, key, "left").where("__from is null or seq >= __from")
    each = valid.select(key, "seq", F.explode(F.from_json("state", "map<string, string>")).alias("field", "value"))
    latest_ = each.groupBy(key, "field").agg(F.max_by("value", "seq").alias("value"))
    fields = latest_.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    none = F.create_map().cast("map<string, string>")
    return log.select(key).distinct().join(fields, key, "left").withColumn("fields", F.coalesce("fields", none))


def file_of(name: str) -> tuple[Column, Column]:
    """A stored file's id and original name: its name is cut at the first ``_``; without one both are the name."""
    n = F.col(name)
    cut = F.instr(n, "_")
    return F.when(cut > 0, F.substring_index(n, "_", 1)).otherwise(n), F.when(cut > 0, F.expr(f"substring({name}, instr({name}, '_') + 1)")).otherwise(n)


def file_listing(files: DataFrame, status: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files (name, file_id) with parse status: as recorded, else completed if a parsed file exists, else
    pending.  Parsed files themselves are not listed."""
    own = files.where("not endswith(name, '_parsed.json')")
    found = own.join(status.select("file_id", F.col("status").alias("__s"), F.col("chapter_count").alias("__c")), "file_id", "left").join(parsed.select("file_id", F.lit(True).alias("__p")).distinct(), "file_id", "left")
    return found.withColumns({"parse_status": F.coalesce("__s", F.when(F.col("__p"), "completed"), F.lit("pending")), "chapter_count": F.coalesce("__c", F.lit(0))}).drop("__s", "__c", "__p")
