"""Conversation state as a streaming aggregate: messages so far, last turn, current topic."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from inkmill.operators.dialogue import TOPICS, topic_of
from inkmill.sources.scratch import shared_folder


def conversation_state(messages: DataFrame, topics=TOPICS) -> DataFrame:
    """(conv_id, messages, last_turn, current_topic), of a static or a streaming table."""
    topic = topic_of("text", topics)
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.max_by(topic, F.when(topic.isNotNull(), F.col("turn"))).alias("current_topic"))


def run_available(spark: SparkSession, path: str, topics=TOPICS) -> DataFrame:
    """Read what is at ``path`` as a stream, keep the state, and return its last version.

    Each micro-batch writes the changed conversations with its number; the latest row of each counts."""
    base = f"{shared_folder(spark)}/conversations-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may match a file or a folder; a plain path must be a folder
    state = conversation_state(spark.readStream.schema(schema).parquet(pattern), topics)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    rows = spark.read.schema(StructType([*state.schema.fields, StructField("version", IntegerType())])).parquet(f"{base}/out/*")
    columns = state.columns
    return rows.groupBy("conv_id").agg(F.max_by(F.struct(*columns[1:]), "version").alias("s")).select("conv_id", "s.*")
