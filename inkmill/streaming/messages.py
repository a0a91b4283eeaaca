"""Messages as a stream with state by conversation: the topic and the last messages, told for each message.

State of a conversation is its last ``n`` messages (list state, in order of turns, each with the topic it names)
and the last topic named before these (value state).  So it is bounded, and a message that comes late still
finds its place: among the last messages it is put by its turn and told the topic as of that turn; one older than
all of them is told the topic it names or else the one known, and changes that only if it is not older.  Messages of one batch
are taken in order of turn.  What was told before stays as it was.  A conversation idle longer than ``idle_ms``
(processing time) is forgotten and begins anew."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkmill.operators.dialogue import ROLES, TOPICS
from inkmill.sources.scratch import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOLD = "conv_id {key}, turn long, role string, text string, current_topic string, history string"


class Recent(StatefulProcessor):
    def __init__(self, topics: tuple[str, ...], n: int, idle_ms: int | None):
        self.topics, self.n, self.idle_ms = topics, n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.before = handle.getValueState("before", "turn long, topic string")
        self.last = handle.getListState("last", "turn long, role string, text string, topic string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [m for part in rows for m in part[["turn", "role", "text"]].itertuples(index=False, name=None)]
        base = self.before.get() if self.before.exists() else (None, None)
        kept = [tuple(m) for m in self.last.get()] if self.last.exists() else []
        out = []
        for turn, role, text in sorted(new, key=lambda m: m[0]):
            role, text = (None if pd.isna(v) else v for v in (role, text))
            named = next((t for t in self.topics if t in (text or "")), None)
            at = sum(m[0] <= turn for m in kept)
            if at == 0 and len(kept) == self.n:  # older than all that is known
                if named is not None and (base[0] is None or base[0] <= turn):
                    base = (turn, named)
                told, lines = named or base[1], [(turn, role, text, named)]
            else:
                kept.insert(at, (int(turn), role, text, named))
                told = next((m[3] for m in reversed(kept[: at + 1]) if m[3] is not None), base[1])
                lines = kept[max(0, at + 1 - self.n) : at + 1]
                for gone in kept[: max(0, len(kept) - self.n)]:
                    if gone[3] is not None and (base[0] is None or base[0] <= gone[0]):
                        base = (gone[0], gone[3])
                kept = kept[-self.n :]
            history = "\n".join(f"{ROLES['user'] if m[1] == 'user' else ROLES['assistant']}: {m[2]}" for m in lines if m[2] is not None)
            out.append((key[0], int(turn), role, text, told, history))
        self.before.update(base)
        self.last.put(kept)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "current_topic", "history"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.before.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def told(messages: DataFrame, topics: tuple[str, ...] = TOPICS, n: int = 10, idle_ms: int | None = None) -> DataFrame:
    """(conv_id, turn, role, text, current_topic, history) of each message of a stream (conv_id, turn, role, text)."""
    ddl = TOLD.format(key=dict(messages.dtypes)["conv_id"])
    mode = "None" if idle_ms is None else "ProcessingTime"
    own = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").where("conv_id is not null and turn is not null")
    return own.groupBy("conv_id").transformWithStateInPandas(Recent(tuple(topics), n, idle_ms), ddl, "Append", mode)


def run_available(spark: SparkSession, path: str, folder: str | None = None, topics: tuple[str, ...] = TOPICS, n: int = 10, idle_ms: int | None = None) -> DataFrame:
    """Read what is new at ``path`` (Parquet) as a stream and return all that was told so far.

    ``folder`` holds the stream's place, its state and what it told, by micro-batch; a batch that is run again
    replaces what it wrote, and a restart with the same folder goes on where the last run ended."""
    folder = folder or f"{shared_folder(spark)}/messages-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    pattern = path if "*" in path else f"{path[:-1]}[{path[-1]}]"  # a pattern may match a file or a folder; a plain path must be a folder
    rows = told(spark.readStream.schema(schema).parquet(pattern), topics, n, idle_ms)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/told/batch={number}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # the kind of state that lists and timers need
    try:
        stream = rows.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(rows.schema).parquet(f"{folder}/told/*")
