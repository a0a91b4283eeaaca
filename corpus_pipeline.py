"""A pipeline over documents: toxic documents go, one of each group of near copies stays, repeated
passages are cut, personal data is masked, and the rest is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs.  Edge cases are those of the operators: null and empty texts pass every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm import jaccard_join, packing, pii, substring_dedup, toxicity
from inkmill.llm.session import discard, read_table, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity reaches one half go."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word n-grams the least doc_id stays."""
    return jaccard_join.representatives(docs, words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a document of smaller doc_id holds are cut out."""
    columns = docs.columns
    cut = substring_dedup.dedup(docs, width=13).withColumn("text", F.col("kept_text"))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed personal data is replaced by its kind."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces of sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", one_of_near_copies),
    ("substring_dedup", cut_repeats),
    ("pii", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)  # what a stage has read is not needed once its output is written
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenisers and learned scores cannot be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None
